"""The registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .centroids import clustered
from .centroids import oracle as centroid_sql
from .chat import format_chat, read_back
from .common import table
from .digests import edited_pairs
from .divergence import oracle as divergence_sql
from .divergence import source_divergence
from .extraction import extract
from .knn import oracle as knn_sql
from .knn import top_products
from .mixing import mix
from .mixing import oracle as mixing_sql
from .packing import pack
from .polytopes import nearest_neighbours
from .quality import score_quality
from .simhash import near_duplicates
from .suffixes import repeated_bytes
from .toxicity import fit as fit_toxicity
from .toxicity import score_documents

QUERIES = {}
ORACLES = {}


def register(name: str, oracle: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run
    return keep


@register("op4_suffix_dedup")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_bytes(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F
    return near_duplicates(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op10_document_fingerprints")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return edited_pairs(table(spark, sf, "documents").select("doc_id", "text"))


@register("op2_source_mixing", mixing_sql())
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken")


@register("op7_best_fit_packing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents").select("doc_id", "text"))


@register("op1_exact_top_k", knn_sql())
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F
    return top_products(table(spark, sf, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@register("op8_chat_formatting")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chat(turns.unionByName(own)))


@register("op9_html_extraction")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return extract(table(spark, sf, "pages").select("page_id", "url", "html"))


@register("op3_toxicity")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return score_documents(docs, fit_toxicity(docs, table(spark, sf, "labels").select("doc_id", "toxic")))


@register("op6_quality_classifier")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return score_quality(table(spark, sf, "documents").select("doc_id", "text"),
                         table(spark, sf, "labels").select("doc_id", "quality"))


@register("op11_centroid_clustering", centroid_sql())
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return clustered(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@register("op12_source_divergence", divergence_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence(table(spark, sf, "documents").select("text", "lang", "source"))


@register("op13_approximate_neighbours")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F
    return nearest_neighbours(table(spark, sf, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
