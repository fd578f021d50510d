"""Problem 8: text cut off by field limits, in pure SQL expressions.

Word trigrams are counted inside the texts, apart by whether a sentence ends behind them. A text's final
trigram that is frequent inside sentences but (almost) never ends one shows a cut between words; a final
word that is unknown after the two words before it, but a beginning of words that are frequent there,
shows a cut inside a word. Where the final trigram is too rare, its last two words decide (told apart).

Numbers are one symbol, line breaks end sentences and trigrams don't cross them. The very end of a text is
never counted as the end of a sentence, so that cut texts don't vouch for each other.

What is added behind texts is learned, not listed: a final line (page numbers, rows of stars, ends of
records) or a final word (marks of a translation, [...]) that many texts share, that stands at ends of texts
rather than inside, and that nothing goes on from. Such lines and words are taken off, however many there
are, and so are ellipses; then the next ones are learned from what is final now, until there are none.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import sound_unions, written

#: Stands for the words before a sentence.
END = "¶"
#: A final line or word is shared if it ends this share of all texts, and at least SHARED of them. A line or
#: word that ends so many texts is one of 1 / SHARE at most, which bounds what is learned at a time.
SHARE, SHARED = 1e-4, 5


def sentences(text):
    """Column of the sentences of a text, with numbers as one symbol."""
    return F.split(F.regexp_replace(text, r"[0-9]+", "#"), r"\n|[.!?]\s+(?=\p{Lu})")


def words(sentence):
    """Column of a sentence's words behind two marks of its beginning, without its final stop."""
    x = F.regexp_replace(F.trim(F.lower(sentence)), r"[.!?]$", "")
    return F.split(F.concat(F.lit(f"{END} {END} "), F.trim(x)), r"\s+")


def sentence_counts(docs: DataFrame, text: str) -> DataFrame:
    """(sentence, n, runs) over all texts; runs counts equal ones one after the other in a text once. Counting
    equal sentences first leaves few of the formulaic ones to be taken apart."""
    s = docs.where(F.col(text).isNotNull()).select(sentences(F.col(text)).alias("s"))
    first = F.transform("s", lambda x, i: F.struct(x.alias("sentence"), ((i == 0) | (x != F.get("s", i - 1))).alias("first")))
    s = s.select(F.inline(first))
    return s.groupBy(F.trim("sentence").alias("sentence")).agg(F.count("*").alias("n"), F.sum(F.col("first").cast("int")).alias("runs"))


def trigram_counts(counted: DataFrame) -> DataFrame:
    """(w1, w2, w3, inside, ends) of the trigrams of sentence_counts()."""
    w = counted.select(words(F.col("sentence")).alias("w"), "n")
    n = F.size("w")
    # w4 is null behind the last word
    zipped = F.arrays_zip(*(F.slice("w", k, n).alias(f"w{k}") for k in range(1, 5)))
    g = w.select(F.inline(zipped).alias("w1", "w2", "w3", "w4"), "n").where("w3 <> ''")
    end = F.col("w4").isNull()
    g = g.select("w1", "w2", "w3", F.when(end, 0).otherwise(F.col("n")).alias("inside"), F.when(end, F.col("n")).otherwise(0).alias("ends"))
    return g.groupBy("w1", "w2", "w3").agg(F.sum("inside").alias("inside"), F.sum("ends").alias("ends"))


# ---- what is added behind texts


def trailer_pattern(lines: list[str], marks: list[str]) -> str:
    """Pattern of any number of ellipses and of the given lines and words (with # for numbers) at the beginning
    of a reversed text. `*+` of Java makes many of them no matter of the stack; SQL engines without it take `*`."""
    quoted = lambda xs: "|".join("".join("(?:[0-9]+|#)" if c == "#" else re.sub(r"([^\w\s])", r"\\\1", c) for c in x[::-1]) for x in sorted(xs))
    kinds = [r"\.\.\.+", "…"]
    kinds += [rf"(?:{quoted(lines)})[ \t]*(?:\n|\z)"] if lines else []
    kinds += [rf"(?:{quoted(marks)})(?:\s|\z)"] if marks else []
    return rf"^(?:\s*(?:{'|'.join(kinds)}))*+\s*"


def with_last_line(docs: DataFrame, text: str, pattern: str) -> DataFrame:
    """docs with `line`, each text's last line without what trailer_pattern() describes, and `whole`, whether
    that line is left as it was (what was taken off began on a line of its own).

    The last lines of a text are looked at first; where nothing of them is left, the whole text is."""
    t = F.coalesce(text, F.lit(""))
    d = docs.withColumn("rev", F.reverse(F.substring_index(t, "\n", -4))).withColumn("rest", F.regexp_replace("rev", pattern, ""))
    d = d.withColumn("all", F.when(F.col("rest") == "", F.reverse(t)))
    d = d.withColumn("rest", F.when(F.col("all").isNotNull(), F.regexp_replace("all", pattern, "")).otherwise(F.col("rest"))).withColumn("rev", F.coalesce("all", "rev"))
    d = d.withColumn("off", F.left("rev", F.length("rev") - F.length("rest")))
    whole = (F.trim(F.translate("off", "\n\r\t", "   ")) == "") | F.col("off").rlike(r"\n[ \t\r]*\z")
    return d.withColumn("line", F.reverse(F.substring_index("rest", "\n", 1))).withColumn("whole", whole)


def _beginnings(counts: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """(by..., w3, longer): how often words that begin with a key's w3 and go on follow the words `by`. Only
    beginnings as long as some key of the same `by` are made; words may have any length."""
    near = counts.join(keys.groupBy(*by).agg(F.collect_set(F.length("w3")).alias("lens")), by)
    fit = F.filter("lens", lambda k: k < F.length("w3"))
    b = near.select(*by, F.explode(F.transform(fit, lambda k: F.substring("w3", F.lit(1), k))).alias("w3"), (F.col("inside") + F.col("ends")).alias("n"))
    return b.groupBy(*by, "w3").agg(F.sum("n").alias("longer"))


def _final(docs: DataFrame, text: str, pattern: str, least: int) -> tuple[dict[str, int], dict[str, int]]:
    """Numbers of texts by final line, and by final word, where it is `least` or more: at most 1 / SHARE each."""
    last = with_last_line(docs.select(F.col(text).alias("text")), "text", pattern)
    n = last.groupBy(F.trim(F.regexp_replace("line", r"[0-9]+", "#")).alias("x")).agg(F.count("*").alias("n")).where("x <> ''")
    word = n.groupBy(F.element_at(F.split("x", r"\s+"), -1).alias("x")).agg(F.sum("n").alias("n"))
    both = n.withColumn("line", F.lit(True)).unionByName(word.withColumn("line", F.lit(False))).where(F.col("n") >= least)
    rows = both.collect()
    return {r["x"]: r["n"] for r in rows if r["line"]}, {r["x"]: r["n"] for r in rows if not r["line"]}


def _occurrences(lines: list[str], marks: list[str], counted: DataFrame, counts: DataFrame) -> dict[tuple[bool, str], tuple[int, int]]:
    """Per line (True) and word (False): how often it occurs (a line in runs), and how often something goes on from it, that
    is words behind a line's last trigram or longer words that begin with the last word."""
    spark = counted.sparkSession
    x = spark.createDataFrame(pa.table({"line": [True] * len(lines) + [False] * len(marks), "x": lines + marks}))
    w = F.when(F.col("line"), words(F.col("x"))).otherwise(F.array(F.lit(""), F.lit(""), F.lower(F.regexp_replace("x", r"[.!?]$", ""))))
    # a line may itself repeat its last trigram, as a row of stars does
    again = F.filter(F.sequence(F.lit(0), F.size("w") - 4), lambda k: F.slice("w", k + 1, 3) == F.slice("w", -3, 3))
    x = x.withColumn("w", w).withColumn("again", F.when(F.size("w") > 3, F.size(again)).otherwise(0))
    x = x.select("line", "x", "again", *(F.element_at("w", k - 4).alias(f"w{k}") for k in (1, 2, 3)))
    lens = F.broadcast(x.groupBy("w1", "w2").agg(F.collect_set(F.length("w3")).alias("lens")))
    # the vocabulary is a context of its own, named by two empty words
    vocabulary = counts.groupBy("w3").agg(F.sum("inside").alias("inside"), F.sum("ends").alias("ends"))
    near = counts.unionByName(vocabulary.withColumn("w1", F.lit("")).withColumn("w2", F.lit(""))).join(lens, ["w1", "w2"])
    fit = F.filter("lens", lambda k: k <= F.length("w3"))
    near = near.select("w1", "w2", "inside", (F.col("inside") + F.col("ends")).alias("n"), F.length("w3").alias("len"), F.explode(F.transform(fit, lambda k: F.substring("w3", F.lit(1), k))).alias("w3"))
    same = F.col("len") == F.length("w3")
    near = near.join(F.broadcast(x), ["w1", "w2", "w3"]).select("line", "x", "again", F.when(same & ~F.col("line"), F.col("n")).otherwise(0).alias("total"), F.when(~same, F.col("n")).when(F.col("line"), F.col("inside")).otherwise(0).alias("on"))
    whole = counted.join(F.broadcast(x.where("line").select("line", "x", "again")), counted["sentence"] == F.col("x")).select("line", "x", "again", F.col("runs").alias("total"), (-F.col("again") * F.col("n")).alias("on"))
    got = near.unionByName(whole).groupBy("line", "x").agg(F.sum("total").alias("total"), F.sum("on").alias("on")).collect()
    return {(r["line"], r["x"]): (r["total"], r["on"]) for r in got}


def learn_trailers(docs: DataFrame, text: str, counted: DataFrame, counts: DataFrame, mostly: float = 0.5, goes_on: float = 0.02) -> tuple[list[str], list[str]]:
    """Final lines and final words that were added behind texts.

    Each is final in max(SHARED, SHARE * rows) texts or more and in at least `mostly` of its occurrences; for
    at most `goes_on` of these does something go on from it: words behind its last trigram (a line) or longer
    words that begin with it. (counted, counts: sentence_counts() and trigram_counts() of the texts.)"""
    lines: list[str] = []
    marks: list[str] = []
    known: dict[tuple[bool, str], tuple[int, int]] = {}
    texts = docs.where(F.col(text) != "")
    least = max(SHARED, int(SHARE * docs.count()))

    def added(is_line: bool, x: str, n: int) -> bool:
        total, on = known.get((is_line, x), (0, 0))
        return 0 < total <= n / mostly and on <= goes_on * n

    while True:
        by_line, by_word = _final(texts, text, trailer_pattern(lines, marks), least)
        # how often a line or word occurs is asked once
        new = ([x for x in by_line if (True, x) not in known], [x for x in by_word if (False, x) not in known])
        if new[0] or new[1]:
            known |= {(True, x): (0, 0) for x in new[0]} | {(False, x): (0, 0) for x in new[1]} | _occurrences(*new, counted, counts)
        new_lines = [x for x, n in by_line.items() if added(True, x, n)]
        # words of lines that were found don't count as final words
        for x in new_lines:
            if (w := x.split()[-1]) in by_word:
                by_word[w] -= by_line[x]
        new_marks = [x for x, n in by_word.items() if n >= least and added(False, x, n)]
        if not new_lines and not new_marks:
            return lines, marks
        lines += new_lines
        marks += new_marks


def cut_texts(
    docs: DataFrame,
    id_col: str,
    text: str,
    *keep: str,
    least: int = 8,
    most_ends: float = 0.02,
    trailers: tuple[list[str], list[str]] | None = None,
) -> DataFrame:
    """(id_col, keep..., final, inside, ends, longer, cut, how) for every row.

    `final` is the final trigram, `inside`, `ends` and `longer` its counts; `cut` is true if
    inside + longer >= least and ends <= most_ends * (inside + longer), for the trigram (how = 'trigram') or,
    where the trigram was seen fewer than `least` times, for its last two words (how = 'pair'); how is null
    where a text is not cut; `keep` may hold none of these names. trailers: lines and words that were added behind texts, if they are known; else
    they are learned. Null and empty texts are not cut; a sentence of fewer than three words is judged with
    marks of its beginning before it. Repeated rows are judged each; texts are read whole.
    """
    sound_unions(docs.sparkSession)
    counted = written(sentence_counts(docs, text))
    counts = written(trigram_counts(counted))
    lines, marks = learn_trailers(docs, text, counted, counts) if trailers is None else trailers
    row = F.struct(id_col, *keep).alias("row")
    fin = with_last_line(docs.select(row, F.col(text).alias("text")), "text", trailer_pattern(lines, marks)).select("row.*", F.col("line").alias("__line"), F.col("whole").alias("__whole"))
    trigram = F.concat_ws(" ", F.slice(words(F.element_at(sentences(F.col("__line")), -1)), -3, 3))
    fin = written(fin.select(id_col, *keep, trigram.alias("final"), F.col("__whole").cast("int").alias("whole")))
    part = F.split("final", " ")
    # nothing can be cut where there is no word; those texts, however many, stay out of the joins
    none = F.col("final").endswith(f" {END}") | F.col("final").endswith(" ")
    keys = fin.where(~none).groupBy("final").agg(F.sum("whole").alias("n"))
    keys = keys.select("final", "n", *(part[k].alias(f"w{k + 1}") for k in range(3)))  # sentences left whole are among the ends
    pairs = counts.groupBy("w2", "w3").agg(F.sum("inside").alias("inside"), F.sum("ends").alias("ends"))
    keys2 = keys.groupBy("w2", "w3").agg(F.sum("n").alias("n2"))
    seen = (
        keys.join(counts, ["w1", "w2", "w3"], "left")
        .join(_beginnings(counts, keys, ["w1", "w2"]), ["w1", "w2", "w3"], "left")
        .join(keys2.join(pairs.select("w2", "w3", F.col("inside").alias("inside2"), F.col("ends").alias("ends2")), ["w2", "w3"], "left"), ["w2", "w3"], "left")
        .join(_beginnings(pairs, keys2, ["w2"]).withColumnRenamed("longer", "longer2"), ["w2", "w3"], "left")
        .na.fill(0, ["inside", "ends", "longer", "inside2", "ends2", "longer2"])
        .withColumn("ends", F.col("ends") - F.col("n"))
        .withColumn("ends2", F.col("ends2") - F.col("n2"))
    )
    go3, go2 = F.col("inside") + F.col("longer"), F.col("inside2") + F.col("longer2")
    by3 = (go3 >= least) & (F.col("ends") <= most_ends * go3)
    by2 = (go2 >= least) & (F.col("ends2") <= most_ends * go2)
    rare = go3 + F.col("ends") < 50
    # a rare trigram alone proves little: its last two words must not be usual at ends of sentences
    few = go3 + F.col("ends") < least
    is_cut = F.when(few, by2).when(rare, by3 & (F.col("ends2") <= 0.1 * go2)).otherwise(by3)
    seen = seen.select("final", "inside", "ends", "longer", F.when(is_cut, F.when(few, "pair").otherwise("trigram")).alias("how"))
    out = fin.where(~none).join(seen, "final", "left")
    out = out.unionByName(fin.where(none), allowMissingColumns=True)
    return out.select(id_col, *keep, "final", "inside", "ends", "longer", F.col("how").isNotNull().alias("cut"), "how")


def cut_report(judged: DataFrame, by: str) -> DataFrame:
    """How often each value of `by` (null is a value) cuts: texts, cut texts, those of them told by their
    last two words only, and the share of cut texts."""
    return judged.groupBy(by).agg(
        F.count("*").alias("n_texts"), F.sum(F.col("cut").cast("int")).alias("n_cut"),
        F.sum((F.coalesce("how", F.lit("")) == "pair").cast("int")).alias("n_by_pair"), F.avg(F.col("cut").cast("double")).alias("share_cut"),
    )
