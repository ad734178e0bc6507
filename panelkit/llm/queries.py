"""The operators over the given tables, one query each, with the parameters meant for production."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelkit.llm import chat, decontaminate, prefixes, quality, toxicity
from panelkit.llm.common import remainder, table
from panelkit.llm.langid import learn, with_language
from panelkit.llm.pieces import encoded
from panelkit.llm.ppm import scored
from panelkit.llm.pseudonyms import pseudonym_report
from panelkit.llm.secrets import secret_report
from panelkit.llm.simhash import simhash_report
from panelkit.llm.vectors import range_links
from panelkit.llm.whitening import whitened

#: The public vocabulary the queries use; operators take the path as a parameter.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op1_langid(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = table(spark, folder, "documents").withColumn("held_out", remainder("doc_id", 3) == 1)
    return with_language(docs, learn(docs.filter(~F.col("held_out"))), ["doc_id", "held_out"])


@query
def op2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives the text back."""
    return encoded(table(spark, folder, "documents"), PIECES, check=True)


@query
def op3_ppm(spark: SparkSession, folder: str) -> DataFrame:
    """Log chances of every document under a byte model and a unigram base, learnt from those that are not held out."""
    docs = table(spark, folder, "documents").withColumn("held_out", remainder("doc_id", 10) == 0)
    return scored(docs, docs.filter(~F.col("held_out")), keep=("held_out",))


@query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash of every document, and the components of those within three bits."""
    return simhash_report(table(spark, folder, "documents"))


@query
def op5_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors with cosine 0.95 or more."""
    return range_links(table(spark, folder, "embeddings"))


SQL["op5_vectors"] = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS size FROM e),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
      WHERE a.size > 0 AND b.size > 0 AND list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.95),
reach AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
many AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
       vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN low ON vec_id = low.a LEFT JOIN many ON vec_id = many.a
"""


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of those that are not held out."""
    docs = table(spark, folder, "documents").withColumn("held_out", remainder("doc_id", 5) == 0)
    labels = table(spark, folder, "labels").filter(remainder("doc_id", 5) != 0)
    net = toxicity.learn(docs.filter(~F.col("held_out")), labels)
    return toxicity.with_toxicity(docs, net, ["doc_id", "held_out"])


@query
def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation formatted and read back, and one whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    tricky = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.chat_report(table(spark, folder, "conversations").select(*tricky.columns).unionByName(tricky))


SQL["op7_chat"] = chat.SQL


@query
def op8_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal numbers, dates and addresses permuted within their format."""
    return pseudonym_report(table(spark, folder, "documents"), key="corpus-2024")


@query
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_report(table(spark, folder, "documents"))


@query
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a passage of a benchmark item."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op10_decontaminate"] = decontaminate.SQL


@query
def op11_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations, with the totals of what follows it."""
    return prefixes.trie_report(table(spark, folder, "conversations"))


SQL["op11_prefixes"] = prefixes.SQL


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable vector's share of the sixteen leading components, scaled to unit covariance."""
    return whitened(table(spark, folder, "embeddings"))


@query
def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learnt from trusted texts and unlabelled ones that are not held out."""
    docs = table(spark, folder, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    labels = table(spark, folder, "labels").filter(remainder("doc_id", 4) != 2)
    net = quality.learn(docs.filter(~F.col("held_out")), labels)
    return quality.with_quality(docs, net, ["doc_id", "held_out"])
