"""Corpus sources and sinks: schemas, loaders, import mapping, upserts and logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions import text as X

BASE_COLUMNS = "source source_text_id source_sentence_id language_stage script_type genre period hieroglyphs mdc sign_sequence transliteration_gold translation lemma_sequence upos glossing grammar_notes source_ref review_status formula_type deity recipient offering_items formula_slot display_sequence normalized_reading_order alt_transliterations variant_writing_note morphology_note syntax_note aesthetic_arrangement_flag".split()
KEYS = BASE_COLUMNS[:3]
REQUIRED = ["source", "source_text_id", "source_sentence_id", "transliteration_gold", "mdc", "translation", "source_ref", "review_status"]
DERIVED = {
    "mdc_norm": ("mdc", X.norm_mdc), "sign_sequence_norm": ("sign_sequence", X.norm_signs), "hieroglyphs_norm": ("hieroglyphs", X.norm_hieroglyphs),
    "transliteration_norm": ("transliteration_gold", X.norm_translit), "formula_type_norm": ("formula_type", X.norm_label), "deity_norm": ("deity", X.norm_label),
    "recipient_norm": ("recipient", X.norm_label), "offering_items_norm": ("offering_items", X.norm_pipe), "formula_slot_norm": ("formula_slot", X.norm_label),
    "display_sequence_norm": ("display_sequence", X.norm_signs), "normalized_reading_order_norm": ("normalized_reading_order", X.norm_signs),
    "alt_transliterations_norm": ("alt_transliterations", X.norm_pipe), "aesthetic_arrangement_flag_bool": ("aesthetic_arrangement_flag", X.parse_bool),
}
BENCHMARK_COLUMNS = "benchmark_id query_mdc query_normalized_reading_order expected_source expected_source_text_id expected_source_sentence_id notes".split()
COMPETITIVE_COLUMNS = "benchmark_id query_input query_type expected_transliteration expected_source_text_id expected_source_sentence_id expected_key_tokens expected_lemma_ids acceptable_token_overlap_threshold notes".split()
# Names under which the fields of imported records may stand, the first present and filled one counts.
ALIASES = {
    "source_text_id": ["source_text_id", "text_id", "textId", "text.id", "document.id", "source.id"],
    "source_sentence_id": ["source_sentence_id", "sentence_id", "sentenceId", "sentence.id", "id", "_id"],
    "language_stage": ["language_stage", "languageStage", "language", "stage"],
    "script_type": ["script_type", "scriptType", "script", "writingSystem"],
    "period": ["period", "dating", "date", "epoch"],
    "genre": ["genre", "textGenre", "category"],
    "hieroglyphs": ["hieroglyphs", "hieroglyphic", "glyphs", "mdcHieroglyphs"],
    "transliteration_gold": ["transliteration_gold", "transliteration", "transcription", "transcriptionAscii", "sentence.transliteration", "tokens.transliteration"],
    "translation": ["translation", "translation_de", "translations.de", "german", "sentence.translation"],
    "lemma_sequence": ["lemma_sequence", "lemmatization", "lemmas", "lemmaIds", "tokens.lemma"],
    "upos": ["upos", "UPOS", "pos", "partOfSpeech", "tokens.upos"],
    "glossing": ["glossing", "gloss", "glosses", "tokens.gloss"],
    "source_ref": ["source_ref", "url", "tla_sentence_url", "reference"],
}
DEFAULTS = {"genre": "offering_formula", "period": "Middle Egyptian", "review_status": "seed"}
ENVELOPES = ["rows", "data", "sentences", "items", "records"]


def conform(df: DataFrame, columns: Sequence[str] = BASE_COLUMNS) -> DataFrame:
    """Missing columns as "", nulls and null words as ""; other columns stay."""
    present = {c.lower(): c for c in df.columns}
    made = []
    for c in columns:
        if (old := present.get(c.lower())) is None:
            made.append(F.lit("").alias(c))
        else:
            value = F.col(f"`{old}`").cast("string")
            made.append(F.when(value.isNull() | value.isin(X.NULL_WORDS), F.lit("")).otherwise(value).alias(c))
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {x.lower() for x in columns}]
    return df.select(*rest, *made)


def derive(df: DataFrame) -> DataFrame:
    """Adds the derived columns, a pure projection."""
    return df.withColumns({name: f(F.col(c)) for name, (c, f) in DERIVED.items()})


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Strings only, quoted fields may hold line breaks and doubled quotes."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', sep=sep, inferSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', quote='"')


def load_examples(spark: SparkSession, path: str) -> DataFrame:
    """A corpus CSV with all base and derived columns and `ord`, a number that follows the file's row order."""
    return derive(conform(read_csv(spark, path))).withColumn("ord", F.monotonically_increasing_id())


def load_benchmark(spark: SparkSession, path: str, columns: Sequence[str] = BENCHMARK_COLUMNS, missing_ok: bool = True) -> DataFrame:
    """A benchmark CSV. A missing file gives an empty frame or FileNotFoundError, a missing column ValueError."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        if not missing_ok:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = read_csv(spark, path)
    if lost := [c for c in columns if c not in df.columns and c != "notes"]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df.na.fill("")


def read_records(spark: SparkSession, folder: str) -> DataFrame | None:
    """Records of all .json, .jsonl, .csv and .tsv files below a folder; broken lines and files are skipped."""
    read = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("mode", "DROPMALFORMED")
    found = []
    for glob, make in (("*.jsonl", lambda r: r.json(folder)), ("*.json", lambda r: unwrap(r.option("multiLine", True).json(folder))), ("*.csv", lambda r: r.csv(folder, header=True, multiLine=True, escape='"')), ("*.tsv", lambda r: r.csv(folder, header=True, multiLine=True, escape='"', sep="\t"))):
        try:
            df = make(read.option("pathGlobFilter", glob))
        except Exception:  # no such file below the folder
            continue
        if df.columns:
            found.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [flatten(f) for f in found]) if found else None


def unwrap(df: DataFrame) -> DataFrame:
    """The list under the first envelope name, else the records themselves."""
    for name in ENVELOPES:
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
            return df.select(F.explode(name).alias("r")).select("r.*") if isinstance(df.schema[name].dataType.elementType, T.StructType) else df
    return df


def flatten(df: DataFrame) -> DataFrame:
    """Nested fields as string columns with dotted names; lists of structs as parallel lists joined by bars."""

    def walk(path: Column, kind: T.DataType, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [c for f in kind for c in walk(path[f.name], f.dataType, f"{name}.{f.name}" if name else f.name)]
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return [c for f in kind.elementType for c in walk(path[f.name], T.ArrayType(f.dataType), f"{name}.{f.name}")]
        if isinstance(kind, T.ArrayType):
            return [F.array_join(path.cast("array<string>"), "|").alias(name)]
        return [path.cast("string").alias(name)]

    return df.select(*[c for f in df.schema for c in walk(F.col(f"`{f.name}`"), f.dataType, f.name)])


def first_alias(df: DataFrame, names: Sequence[str]) -> Column:
    """The first filled column among names: exact, then without case, then by the last part of a dotted name."""
    order = [c for n in names for c in df.columns if c == n]
    order += [c for n in names for c in df.columns if c.lower() == n.lower() and c not in order]
    order += [c for n in names for c in df.columns if c.split(".")[-1].lower() == n.lower() and c not in order]
    filled = [F.nullif(X.safe_text(F.col(f"`{c}`")), F.lit("")) for c in order]
    return F.coalesce(*filled, F.lit(""))


def import_records(df: DataFrame, source: str, origin: str, order: str | None = None, buckets: int = 256) -> DataFrame:
    """Raw records as corpus rows: aliases, derived query key, period of the dates, generated ids, one row a key.

    Records without transliteration are dropped. Generated ids number the accepted records by `order` (or by content),
    without a single-task sort: ranges of the order get their offsets from counts a range. The first of a key stays.
    """
    flat = flatten(df) if order is None else df
    get = {k: first_alias(flat, v) for k, v in ALIASES.items()}
    year = lambda n: X.parse_year(F.col(f"`{n}`")) if n in flat.columns else F.lit(None).cast("int")
    rows = flat.select(*[c.alias(k) for k, c in get.items()], X.derive_period(year("dateNotBefore"), year("dateNotAfter")).alias("_dated"), (F.col(order) if order else F.xxhash64(*[F.col(f"`{c}`") for c in flat.columns])).alias("_ord")).where("transliteration_gold <> ''")
    ranged = rows.repartitionByRange(buckets, "_ord").sortWithinPartitions("_ord").withColumn("_part", F.spark_partition_id()).persist()
    counts = ranged.groupBy("_part").count()  # one row a range
    before = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    n = (F.row_number().over(Window.partitionBy("_part").orderBy("_ord")) + F.col("_before")).cast("int")
    rows = ranged.join(F.broadcast(before), "_part").withColumn("_n", n)
    mdc = X.norm_mdc(X.norm_translit("transliteration_gold"))
    or_else = lambda c, d: F.when(F.col(c) == "", d).otherwise(F.col(c))
    out = rows.select(
        F.lit(source).alias("source"), or_else("source_text_id", F.format_string(f"{source}_EARLIER_%03d", "_n")).alias("source_text_id"), or_else("source_sentence_id", F.format_string("S%03d", "_n")).alias("source_sentence_id"),
        or_else("language_stage", F.lit("Earlier Egyptian")).alias("language_stage"), or_else("script_type", F.lit("hieroglyphic/hieratic")).alias("script_type"), or_else("genre", F.lit("unknown")).alias("genre"),
        F.when(F.col("_dated") != "", F.col("_dated")).otherwise(or_else("period", F.lit("Earlier Egyptian"))).alias("period"), "hieroglyphs", mdc.alias("mdc"), F.col("transliteration_gold").alias("sign_sequence"), "transliteration_gold", "translation", "lemma_sequence", "upos", "glossing",
        or_else("source_ref", F.concat(F.lit(f"{origin}#row="), F.col("_n").cast("string"))).alias("source_ref"), F.lit("seed").alias("review_status"), or_else("hieroglyphs", F.col("transliteration_gold")).alias("display_sequence"), mdc.alias("normalized_reading_order"), F.lit("False").alias("aesthetic_arrangement_flag"), F.col("_n").cast("long").alias("ord"),
    )
    return conform(first_of(out, KEYS, "ord"))


def first_of(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key, by a partial aggregate that carries the row; a hot key costs one row a task."""
    columns = df.columns
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("r")).select("r.*")


def with_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(X.safe_text(c) == "", F.lit(d)).otherwise(X.safe_text(c)) for c, d in DEFAULTS.items()})


def missing_fields(columns: Sequence[str] = REQUIRED) -> Column:
    return F.filter(F.array(*[F.when(X.safe_text(c) == "", F.lit(c)) for c in columns]), lambda x: x.isNotNull())


def complete(df: DataFrame, order: str = "ord") -> DataFrame:
    """Defaults filled, rows with all required fields, the first of each key."""
    return first_of(with_defaults(df).where(F.size(missing_fields()) == 0), KEYS, order)


def upsert_plan(old: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS, fields: Sequence[str] | None = None) -> DataFrame:
    """Keys, id, action (created, updated, unchanged, kept) and the changed fields; keys of both sides are unique.

    Ids of known keys stay; a null compares as a value. Null keys match null keys.
    """
    fields = list(fields or [c for c in BASE_COLUMNS if c not in keys])
    a = old.select("id", *keys, F.struct(*fields).alias("was")).alias("a")
    b = new.select(*keys, F.struct(*fields).alias("now")).alias("b")
    same_key = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    changed = F.filter(F.array(*[F.when(~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    joined = a.join(b, same_key, "full")
    action = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "kept").when(F.size(changed) > 0, "updated").otherwise("unchanged")
    both = F.col("was").isNotNull() & F.col("now").isNotNull()
    return joined.select("id", *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], action.alias("action"), F.when(both, changed).otherwise(F.array().cast("array<string>")).alias("changed"), "was", "now")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS, fields: Sequence[str] | None = None, buckets: int = 256) -> DataFrame:
    """The new snapshot; created rows get ids after the largest old one, by ranges of the key order."""
    plan = upsert_plan(old, new, keys, fields)
    top = old.agg(F.max("id")).first()[0] or 0
    kept = plan.where("action <> 'created'").select("id", *keys, F.coalesce("now", "was").alias("r"))
    made = plan.where("action = 'created'").select(*keys, F.col("now").alias("r")).repartitionByRange(buckets, *keys).withColumn("_part", F.spark_partition_id()).persist()
    before = made.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) + F.col("_before") + top
    created = made.join(F.broadcast(before), "_part").select(number.cast("long").alias("id"), *keys, "r")
    return kept.unionByName(created).select("id", *keys, "r.*")


def upsert_tally(plan: DataFrame) -> DataFrame:
    """(kind, name, n): rows by action and changes by field."""
    actions = plan.groupBy(F.lit("action").alias("kind"), F.col("action").alias("name")).agg(F.count("*").alias("n"))
    fields = plan.select(F.explode("changed").alias("name")).groupBy(F.lit("field").alias("kind"), "name").agg(F.count("*").alias("n"))
    return actions.unionByName(fields)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return new.join(old.select(*keys), list(keys), "left_anti")


def ensure_seeded(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Writes the rows only where the table is absent or empty; returns how many the table has."""
    try:
        have = spark.read.parquet(path)
        if not have.isEmpty():
            return have.count()
    except Exception:  # no table yet
        pass
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path).count()


def annotation_row(example_id: int, transliteration: str, aesthetic_arrangement_flag: object = False, **fields: str) -> dict:
    flag = aesthetic_arrangement_flag.strip().lower() in X.TRUE_WORDS if isinstance(aesthetic_arrangement_flag, str) else bool(aesthetic_arrangement_flag)
    return {"example_id": example_id, "transliteration": transliteration, "status": "edited", "aesthetic_arrangement_flag": flag} | fields


def run_log(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """One row a query: ids joined by commas in rank order, scores with four digits."""
    listed = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "final_score"))).alias("r"))
    ids = F.array_join(F.transform("r", lambda x: x["id"].cast("string")), ",")
    scores = F.array_join(F.transform("r", lambda x: F.format_string("%.4f", x["final_score"])), ",")
    return queries.join(listed, "query_id").select("query_id", "query_mdc", "query_reading_order", ids.alias("top_example_ids"), scores.alias("top_scores"))
