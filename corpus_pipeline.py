"""The corpus pipeline: language, near-duplicates, benchmark passages, secrets, piece ids.

Each stage takes the documents its predecessor kept and decides about all of them, row by row: rows that share an id or have
none are told apart by a number of their own. All but the last stage return the columns of the documents they were given.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelkit.llm.common import map_texts, remainder, table
from panelkit.llm.decontaminate import contaminated
from panelkit.llm.langid import NO_LANGUAGE, Settings, identify, learn, with_language
from panelkit.llm.pieces import encoded
from panelkit.llm.queries import PIECES
from panelkit.llm.secrets import RULES, find, machines, masked
from panelkit.llm.simhash import near_duplicates
from panelkit.session import settle

#: The share of held-out texts, of those whose language is told rightly, that the bar for a language lets through.
KEPT = 0.999
#: Words in a shingle of the near-duplicate stage.
SHINGLE = 3


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _row(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written so that it stays the same, and the number's column."""
    row = _free(docs, "row_number")
    return settle(docs.withColumn(row, F.monotonically_increasing_id())), row


def language_bar(docs: DataFrame, net) -> float:
    """The score that ``KEPT`` of the labelled texts reach whose language ``net`` tells rightly; 0 without any."""
    told = with_language(docs.filter(F.col("lang").isNotNull()), net, ["lang"]).filter("lang = lang_pred")
    bar = told.agg(F.percentile_approx("score", 1 - KEPT, F.lit(10_000)).alias("bar")).first()["bar"]
    return bar or 0.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach: those without letters, or too uncertain to call, go.

    Null, empty and letterless texts go. The network is learnt from two thirds of the labelled rows, and beside their languages
    a class of none of them; the bar for its score is set on the held-out third, such that ``KEPT`` of the rightly told texts
    there stay. Without labelled rows every text with a letter stays.
    """
    lettered = docs.filter(F.col("text").rlike(r"\p{L}"))
    held_out = remainder("doc_id", 3) == 1
    net = learn(docs.filter(~held_out), settings=Settings(background=0.5))
    if net is None:
        return lettered
    none = net.languages.index(NO_LANGUAGE)
    bar = language_bar(docs.filter(held_out).select("text", "lang"), net)
    sure = _free(docs, "sure")

    def work(batch):
        best, score = identify(net, batch.column("text"))
        return {sure: (best != none) & (score >= bar)}

    return map_texts(lettered, "text", docs.columns, f"`{sure}` boolean", work).filter(F.col(sure)).drop(sure)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, among equal ids any one.

    Fingerprints of three-word shingles link within three bits. Null, empty and blank texts have one fingerprint and so are
    one group. Rows without an id come last in their group: one stays only where no row of the group has an id.
    """
    rows, row = _row(docs)
    key = _free(rows, "key")
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")).alias(key), "text")
    groups = near_duplicates(keyed, key, "text", words=SHINGLE)
    keep = groups.filter(F.col(key) == F.col("component_id")).select(F.col(f"{key}.row").alias(row))
    return rows.join(keep, row, "left_semi").select(docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Rows are judged one by one: those without an id like all others, and of
    rows that share an id only those go whose own text holds a passage."""
    rows, row = _row(docs)
    leaks = contaminated(rows.select(row, "text"), table(spark, sf_dir, "benchmark"), doc=row).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(leaks, row, "left_anti").select(docs.columns)


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their text masked; ``n_chars`` follows the text where it changes."""
    machine = machines(RULES)
    new, size = _free(docs, "masked"), _free(docs, "masked_size")

    def work(batch):
        texts = batch.column("text")
        found = find(texts, RULES, machine)
        out = masked(texts.to_pylist(), found)
        return {new: pa.array(out, pa.string()), size: pa.array([len(t) if f else None for t, f in zip(out, found)], pa.int64())}

    done = map_texts(docs, "text", docs.columns, f"`{new}` string, `{size}` long", work)
    changed = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.col(size).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return done.withColumns(changed).select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left, with the language and source of each document."""
    return encoded(docs, PIECES, [c for c in ("doc_id", "lang", "source") if c in docs.columns])


STAGES = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("benchmark_free", benchmark_free),
    ("secret_free", secret_free),
    ("pieces", pieces),
]

#: Networks, fingerprints and automata have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
