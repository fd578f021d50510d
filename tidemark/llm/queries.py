"""Queries p6 to p8 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import mixing, packing, tokens, truncated


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(tokens.with_sizes(table(spark, d, "documents"), "doc_id", "text"))
    kinds = table(spark, d, "container_sizes").select("container", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    return packing.pack(sizes, "doc_id", "n_tokens", kinds)


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(_packed(spark, d))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing, counted per container: every document in all its pieces, no bin beyond its
    capacity, no document split that fits, bins of full pieces alone."""
    sizes = cut(tokens.with_sizes(table(spark, d, "documents"), "doc_id", "text"))
    kinds = table(spark, d, "container_sizes").select("container", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    p = packing.pack(sizes, "doc_id", "n_tokens", kinds)
    docs = p.groupBy("container", "capacity", "doc_id").agg(F.sum("size").alias("got"), F.count("*").alias("pieces"), F.countDistinct("piece").alias("numbers"), F.max("n_pieces").alias("n_pieces"))
    docs = docs.join(sizes, "doc_id", "full")
    wrong = (F.coalesce("got", F.lit(-1)) != F.col("n_tokens")) | (F.col("pieces") != F.col("n_pieces")) | (F.col("numbers") != F.col("pieces"))
    split = (F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity"))
    a = docs.groupBy("container").agg(F.count("*").alias("n_docs"), F.count_if(wrong).alias("n_wrong"), F.count_if(split).alias("n_split_small"))
    bins = p.groupBy("container", "capacity", "bin").agg(F.sum("size").alias("used"))
    b = bins.groupBy("container").agg(F.count_if(F.col("used") > F.col("capacity")).alias("n_overfull"), F.count("*").alias("bins"), F.sum("used").alias("used"), F.first("capacity").alias("capacity"))
    # no more than 2 % of the room, and two bins, are left over
    tight = (F.col("bins") - 2) * F.col("capacity") * 0.98 <= F.col("used")
    return a.join(b, "container").select("container", "n_docs", "n_wrong", "n_split_small", "n_overfull", tight.alias("tight"))


def _mixed(spark: SparkSession, d: str):
    sizes = cut(tokens.with_sizes(table(spark, d, "documents"), "doc_id", "text", "source"))
    items = sizes.select(F.col("doc_id").alias("id"), "source", F.col("n_tokens").alias("size"))
    return mixing.mix(items, table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    rows, _, _ = _mixed(spark, d)
    return rows.select(F.col("id").alias("doc_id"), "source", "copy", F.col("size").alias("n_tokens"), "finish")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixing_report(*_mixed(spark, d))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Per target source with documents: whether it is short of its share of the budget by less than one
    document, and no document is used too often or with gaps in its copies."""
    sizes = cut(tokens.with_sizes(table(spark, d, "documents"), "doc_id", "text", "source"))
    rows, info, b = mixing.mix(sizes.select(F.col("doc_id").alias("id"), "source", F.col("n_tokens").alias("size")), table(spark, d, "mix_targets"))
    r = mixing.mixing_report(rows, info, b).where("tokens_there > 0").join(sizes.groupBy("source").agg(F.max("n_tokens").alias("largest")), "source")
    short = F.col("target_share") * F.col("budget") - F.col("tokens")
    copies = rows.groupBy("source", "id").agg(F.max("copy").alias("top"), F.countDistinct("copy").alias("kinds"), F.count("*").alias("n"))
    copies = copies.groupBy("source").agg(F.max("top").alias("top"), F.count_if((F.col("n") != F.col("kinds")) | (F.col("top") != F.col("kinds"))).alias("odd"))
    return r.join(copies, "source").select(
        "source", "docs_there", ((short > -1e-6) & (short < F.col("largest"))).alias("on_target"), ((F.col("top") <= F.col("max_repeats")) & (F.col("odd") == 0)).alias("copies_ok")
    )


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return truncated.cut_texts(table(spark, d, "documents"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("cut").select("doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return truncated.cut_report(_judged(spark, d), "source")


QUERIES = {f.__name__: f for f in (p6_pack, p6_report, p6_check, p7_mix, p7_report, p7_check, p8_found, p8_report)}


# ---- p8 in SQL

_WORDS = r"['¶', '¶'] || string_split_regex(trim(regexp_replace(trim(lower({})), '[.!?]$', '')), '\s+')"
_SENTENCES = r"string_split(regexp_replace(regexp_replace({}, '[0-9]+', '#', 'g'), '[.!?]\s+(\p{{Lu}})', chr(10) || '\1', 'g'), chr(10))"
_QUOTED = r"string_agg(replace(regexp_escape(reverse(x)), '\#', '(?:[0-9]+|#)'), '|' order by x)"


def _last(k: int) -> str:
    """Relations q{k} (pattern of what is known after k levels of learning) and e{k} (last lines without it)."""
    known = " union all ".join(f"select * from a{i}" for i in range(k)) or "select '' as x, '' as kind where false"
    return rf""", q{k} as (select '^(?:\s*(?:\.\.\.+|…' || coalesce('|(?:' || {_QUOTED} filter (where kind = 'line') || ')[ \t]*(?:\n|\z)', '')
  || coalesce('|(?:' || {_QUOTED} filter (where kind = 'mark') || ')(?:\s|\z)', '') || '))*\s*' as p from ({known})),
r{k} as (select doc_id, source, t, reverse(t) as rev, regexp_replace(reverse(t), (select p from q{k}), '') as rest from d),
e{k} as (select *, reverse(split_part(rest, chr(10), 1)) as line, left(rev, length(rev) - length(rest)) as off from r{k})"""


def _learn(k: int) -> str:
    """Relation a{k}: the lines and words learned on level k."""
    return _last(k) + rf""", f{k} as (select * from (select trim(regexp_replace(line, '[0-9]+', '#', 'g')) as line, count(*) as n from e{k} where t <> '' group by 1) where line <> ''),
g{k} as (select line, f.n as m, s.n as total, {_WORDS.format("line")} as w from f{k} f join s on s.sentence = f.line where f.n >= (select least from b) and f.n >= 0.5 * s.runs),
h{k} as (select line, m, total, w, coalesce(sum(c.i) filter (where c.w3 = w[-1]) - case when len(w) > 3 then len(list_filter(range(len(w) - 3), lambda i: w[i + 1:i + 3] = w[-3:])) * total else 0 end, 0)
  + coalesce(sum(c.i + c.x) filter (where starts_with(c.w3, w[-1]) and length(c.w3) > length(w[-1])), 0) as goes from g{k} left join c on c.w1 = w[-3] and c.w2 = w[-2] group by 1, 2, 3, 4),
n{k} as (select line as x from h{k} where goes <= 0.02 * m),
u{k} as (select word, sum(n) as m, any_value(lower(regexp_replace(word, '[.!?]$', ''))) as w3 from (select *, string_split_regex(line, '\s+')[-1] as word from f{k} where line not in (select x from n{k})) group by 1),
v{k} as (select word, m, w3 from u{k} join v using (w3) where m >= (select least from b) and m >= 0.5 * (v.i + v.x)),
z{k} as (select word, m, coalesce(sum(v.i + v.x), 0) as goes from v{k} y left join v on starts_with(v.w3, y.w3) and length(v.w3) > length(y.w3) group by 1, 2),
a{k} as (select x, 'line' as kind from n{k} union all select word, 'mark' from z{k} where goes <= 0.02 * m)"""


_LEVELS = 3
_CUT = (
    "with d as (select doc_id, source, coalesce(text, '') as t from documents), b as (select greatest(5, floor(1e-4 * count(*)))::bigint as least from d),"
    " s as (select trim(x.s) as sentence, count(*) as n, sum(x.f::int) as runs from (select unnest(list_transform(s, lambda x, i: {'s': x, 'f': i = 1 or x <> s[i - 1]})) as x from (select " + _SENTENCES.format("text") + " as s from documents where text is not null)) group by 1),"
    " w as (select " + _WORDS.format("sentence") + """ as w, n from s),
g as (select w[i - 2] as w1, w[i - 1] as w2, w[i] as w3, i = len(w) as e, n from (select w, n, unnest(range(3, len(w) + 1)) as i from w)),
c as (select w1, w2, w3, sum(case when e then 0 else n end) as i, sum(case when e then n else 0 end) as x from g where w3 <> '' group by 1, 2, 3),
v as (select w3, sum(i) as i, sum(x) as x from c group by 1)"""
    + "".join(map(_learn, range(_LEVELS)))
    + _last(_LEVELS)
    + r""",
fin as (select doc_id, source, w[-3] as w1, w[-2] as w2, w[-1] as w3, whole from (select doc_id, source, """ + _WORDS.format(_SENTENCES.format("line") + "[-1]")
    + r""" as w, (trim(translate(off, chr(10) || chr(13) || chr(9), '   ')) = '' or regexp_matches(off, '\n[ \t\r]*\z'))::int as whole from e""" + str(_LEVELS) + """)),
k as (select w1, w2, w3, sum(whole) as n from fin where w3 <> '' and w3 <> '¶' group by 1, 2, 3),
c2 as (select w2, w3, sum(i) as i, sum(x) as x from c group by 1, 2),
k2 as (select w2, w3, sum(n) as n2 from k group by 1, 2),
p3 as (select k.w1, k.w2, k.w3, sum(c.i + c.x) as p from k join c on c.w1 = k.w1 and c.w2 = k.w2 where starts_with(c.w3, k.w3) and length(c.w3) > length(k.w3) group by 1, 2, 3),
p2 as (select k2.w2, k2.w3, sum(c2.i + c2.x) as p from k2 join c2 on c2.w2 = k2.w2 where starts_with(c2.w3, k2.w3) and length(c2.w3) > length(k2.w3) group by 1, 2),
y as (select k.w1, k.w2, k.w3, coalesce(c.i, 0) + coalesce(p3.p, 0) as go3, coalesce(c.x, 0) - k.n as x3, coalesce(c2.i, 0) + coalesce(p2.p, 0) as go2, coalesce(c2.x, 0) - k2.n2 as x2
  from k join k2 using (w2, w3) left join c using (w1, w2, w3) left join p3 using (w1, w2, w3) left join c2 on c2.w2 = k.w2 and c2.w3 = k.w3 left join p2 on p2.w2 = k.w2 and p2.w3 = k.w3),
j as (select w1, w2, w3, go3 + x3 < 8 as few, case when go3 + x3 < 8 then go2 >= 8 and x2 <= 0.02 * go2 when go3 + x3 < 50 then go3 >= 8 and x3 <= 0.02 * go3 and x2 <= 0.1 * go2
  else go3 >= 8 and x3 <= 0.02 * go3 end as cut from y),
r as (select fin.doc_id, fin.source, coalesce(j.cut, false) as cut, coalesce(j.cut and j.few, false) as pair from fin left join j using (w1, w2, w3))
"""
)
ORACLES: dict[str, str] = {
    "p6_check": "select container, count(*) as n_docs, 0 as n_wrong, 0 as n_split_small, 0 as n_overfull, true as tight from documents, container_sizes group by 1",
    "p7_check": "select source, count(*) as docs_there, true as on_target, true as copies_ok from documents join mix_targets using (source) where target_share > 0 group by 1",
    "p8_found": _CUT + "select doc_id from r where cut",
    "p8_report": _CUT + "select source, count(*) as n_texts, sum(cut::int)::bigint as n_cut, sum(pair::int)::bigint as n_by_pair, avg(cut::int) as share_cut from r group by 1",
}
