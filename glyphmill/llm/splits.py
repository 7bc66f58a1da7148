"""Splits that keep related records together.

Sentences are edges between text ids and sentence ids. Texts that share a sentence id are linked by a star around the
smallest of them, and the text graph is contracted as Borůvka does: every component picks its smallest outgoing edge,
the picked edges join the spanning forest (written to the shared folder each round), components are contracted by
pointer jumping, edges inside a component are dropped. Rounds end when no edge is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.runtime import checkpoint

ABSENT = ["NO_TEXT_ID", "NO_SENTENCE_ID", "", "_"]


def related_id(column: Column) -> Column:
    """Trimmed, upper case, each run of `-`, `_` and blanks one `_`; null for ids that relate nothing."""
    trimmed = F.regexp_replace(column.cast("string"), r"(?U)^\s+|\s+$", "")
    same = F.regexp_replace(F.upper(trimmed), r"(?U)[-_\s]+", "_")
    return F.when(~same.isin(ABSENT), same)


def _halved(links: DataFrame) -> DataFrame:
    """Pointer jumping on (node, to) until every node points at its root."""
    while True:
        there = links.select(F.col("node").alias("to"), F.col("to").alias("further"))
        jumped = checkpoint(links.join(there, "to", "left").select("node", F.coalesce("further", "to").alias("next"), F.col("to").alias("was")))
        links = jumped.select("node", F.col("next").alias("to"))
        if jumped.where("next <> was").isEmpty():
            return links


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest, roots) of a graph of string nodes `a`, `b`: picked edges, and (node, root) for every node with an edge.

    root is one node of the component. Loops and repeated edges do no harm. Edges are picked by their order
    (a, b), which no two different edges share, so picks form no cycle but two components picking one edge.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    rest = checkpoint(edges.where("a <> b").select(least.alias("a"), most.alias("b")).distinct().select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")))
    nodes = rest.select(F.col("a").alias("node")).unionAll(rest.select("b")).distinct()
    roots = checkpoint(nodes.select("node", F.col("node").alias("root")))
    forest = None
    while not rest.isEmpty():
        ends = rest.select(F.col("ca").alias("node"), F.struct("a", "b", F.col("cb").alias("to")).alias("e")).unionAll(rest.select("cb", F.struct("a", "b", F.col("ca").alias("to"))))
        picked = checkpoint(ends.groupBy("node").agg(F.min("e").alias("e")).select("node", "e.to", "e.a", "e.b"))
        forest = picked.select("a", "b") if forest is None else forest.unionAll(picked.select("a", "b"))
        # Two components that picked one edge point at each other; the smaller is the root.
        back = picked.select(F.col("node").alias("to"), F.col("to").alias("back"))
        links = picked.join(back, "to", "left").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("to"))
        links = _halved(links)
        new = links.select(F.col("node").alias("root"), F.col("to").alias("new"))
        roots = checkpoint(roots.join(new, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        ca, cb = (links.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in ("ca", "cb"))
        rest = checkpoint(rest.join(ca, "ca").join(cb, "cb").where("ca2 <> cb2").select("a", "b", F.col("ca2").alias("ca"), F.col("cb2").alias("cb")))
    spark = edges.sparkSession
    forest = spark.createDataFrame([], "a string, b string") if forest is None else forest.distinct()
    return forest, roots


def text_edges(examples: DataFrame) -> DataFrame:
    """Edges between texts that share a sentence id, as stars around the smallest text of each sentence id."""
    rows = examples.select(related_id(F.col("source_text_id")).alias("text"), related_id(F.col("source_sentence_id")).alias("sentence"))
    seen = rows.where("text is not null and sentence is not null").distinct()
    center = seen.groupBy("sentence").agg(F.min("text").alias("center"), F.count("*").alias("n")).where("n > 1")
    return seen.join(center, "sentence").where("text <> center").select(F.col("center").alias("a"), F.col("text").alias("b"))


def related_texts(examples: DataFrame, block: int = 1000) -> DataFrame:
    """(text_a, text_b), text_a < text_b: different texts that must share a split, through however many others.

    A pair for each two texts of a component is what the result is; the texts of a component meet by a join on its root.
    A component of more than `block` texts is dealt to blocks, each of which meets all its texts in a task of its own.
    """
    roots = spanning_forest(text_edges(examples))[1]
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).select("root", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = roots.join(sizes, "root")
    a = dealt.select("root", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.col("node").alias("text_a"))
    b = dealt.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("node").alias("text_b"))
    return a.join(b, ["root", "block"]).where("text_a < text_b").select("text_a", "text_b")


def assign_splits(examples: DataFrame, plan: DataFrame, key: str = "id", whole: int = 256, buckets: int = 1024) -> DataFrame:
    """(id, component, split) for every row: related rows share a split, rows by split near the shares of `plan`.

    A row belongs to the root of its text, else to its sentence id (through a text that has that sentence id, if any),
    else to itself. Components are stratified by size band (power of two of their rows). Bands of the `whole` largest
    components and fewer are dealt one by one to the split that lacks most; the bands below are dealt systematically:
    numbered in hash order within the band, the n-th goes where n times the golden ratio falls among what the splits
    still lack. Null ids get a row each; an empty plan gives a null split.
    """
    rows = examples.select(F.col(key).alias("id"), related_id(F.col("source_text_id")).alias("text"), related_id(F.col("source_sentence_id")).alias("sentence"))
    _, roots = spanning_forest(text_edges(examples))
    of_text = roots.select(F.col("node").alias("text"), "root")
    # A sentence id without text goes with the text that has the same sentence id; texts of one sentence id share a root.
    of_sentence = rows.where("text is not null and sentence is not null").groupBy("sentence").agg(F.min("text").alias("by_sentence"))
    lone = rows.where("text is null and sentence is not null").join(of_sentence, "sentence", "left").select("id", F.col("by_sentence").alias("text"), "sentence")
    lost = rows.where("text is null and sentence is null")
    with_text = rows.where("text is not null").unionAll(lone.where("text is not null").select("id", "text", "sentence"))
    # The texts are few against the rows: a hot text is split by the adaptive skew join, the other side has one row a text.
    named = with_text.join(of_text, "text", "left").select("id", F.concat(F.lit("t:"), F.coalesce("root", "text")).alias("component"))
    named = named.unionAll(lone.where("text is null").select("id", F.concat(F.lit("s:"), F.col("sentence"))))
    named = checkpoint(named.unionAll(lost.select("id", F.concat(F.lit("r:"), F.coalesce(F.col("id").cast("string"), F.uuid())))))

    band = F.floor(F.log2(F.col("n"))).cast("int")
    sizes = checkpoint(named.groupBy("component").agg(F.count("*").alias("n")).withColumn("band", band).withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)).cast("int")))
    shares = [(r["split"], float(r["share"])) for r in plan.select("split", "share").orderBy("split").collect()]  # one row a split
    if not shares:
        return named.select("id", "component", F.lit(None).cast("string").alias("split"))
    bands = sorted(((r.band, r.n, r.c) for r in sizes.groupBy("band").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()), reverse=True)  # at most 64 rows
    total = sum(n for _, n, _ in bands)
    lack = {s: share / sum(x for _, x in shares) * total for s, share in shares}
    singly, left = [], whole
    for b, _, c in bands:
        if c > left:
            break
        singly.append(b)
        left -= c
    dealt = []
    if singly:
        for r in sizes.where(F.col("band").isin(singly)).orderBy(F.desc("n"), "component").collect():  # at most `whole` rows
            to = max(lack, key=lambda s: lack[s])
            lack[to] -= r.n
            dealt.append((r.component, to))
    spark = examples.sparkSession
    big = spark.createDataFrame(dealt, "component string, split string")
    small = sizes.where(~F.col("band").isin(singly)) if singly else sizes
    counts = small.groupBy("band", "bucket").agg(F.count("*").alias("c"))  # at most 64 * buckets rows
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("band").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    number = F.row_number().over(Window.partitionBy("band", "bucket").orderBy(F.xxhash64("component"), "component")) + F.coalesce("before", F.lit(0))
    at = (F.col("number") * 0.6180339887498949) % 1.0
    want = {s: max(x, 0.0) for s, x in lack.items()}
    whole_want = sum(want.values()) or 1.0
    choice, up_to = F.when(F.lit(False), F.lit("")), 0.0
    for s, _ in shares[:-1]:
        up_to += want[s] / whole_want
        choice = choice.when(at < up_to, F.lit(s))
    small = small.join(F.broadcast(before.drop("c")), ["band", "bucket"]).withColumn("number", number).select("component", choice.otherwise(F.lit(shares[-1][0])).alias("split"))
    return named.join(small.unionAll(big), "component").select("id", "component", "split")
