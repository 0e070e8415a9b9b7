"""The registered queries of this package. Each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dyadica.llm.common import fold_of, read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from dyadica.llm.toxicity import fit, score_documents

    docs = read(spark, sf, "documents")
    model = fit(docs, read(spark, sf, "labels"), fold_of("doc_id", 5) != 0)
    scored = score_documents(docs, model, ["doc_id"])
    held_out = (fold_of("doc_id", 5) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted", "n_hits", "n_quoted", "n_misspelled")


def op5_bpe(spark: SparkSession, sf: str) -> DataFrame:
    from dyadica.llm.bpe import encode_documents

    docs = read(spark, sf, "documents")
    return encode_documents(docs, tokenizer_path("byte_bpe_50k.json"), ["doc_id"], ids=False)


def op1_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    from dyadica.llm.neardup import classes

    return classes(read(spark, sf, "documents")).select("doc_id", "class_id", "copy_of")


def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    from dyadica.llm.language import fit_trigrams, identify

    languages, chances = fit_trigrams(read(spark, sf, "documents"))
    return identify(read(spark, sf, "pages"), languages, chances, ["page_id"])


def op3_sketch(spark: SparkSession, sf: str) -> DataFrame:
    from dyadica.llm.sketch import edited_sketches

    return edited_sketches(read(spark, sf, "documents"))


def op6_pii(spark: SparkSession, sf: str) -> DataFrame:
    from dyadica.llm.pii import find_documents, fit

    docs = read(spark, sf, "documents")
    return find_documents(docs, fit(docs), ["doc_id"])


def op7_lattice(spark: SparkSession, sf: str) -> DataFrame:
    from dyadica.llm.lattice import score_documents

    train = fold_of("doc_id", 7) != 2
    scored = score_documents(read(spark, sf, "documents"), tokenizer_path("piece_bpe_32k.model"), train, ["doc_id"])
    held_out = (fold_of("doc_id", 7) == 2).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_entropy_mix(spark: SparkSession, sf: str) -> DataFrame:
    from dyadica.llm.mixing import mix

    return mix(read(spark, sf, "documents"), ["doc_id"])


def op9_licences(spark: SparkSession, sf: str) -> DataFrame:
    from dyadica.llm.licences import scan_documents

    return scan_documents(read(spark, sf, "documents"), ["doc_id"])


def op10_forest(spark: SparkSession, sf: str) -> DataFrame:
    from dyadica.llm.forest import nearest, valid

    vectors = valid(read(spark, sf, "embeddings"), "vec_id", "embedding")
    return nearest(vectors, vectors.filter("id % 20 = 0"), 20)


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    from dyadica.llm.whitening import whiten

    return whiten(read(spark, sf, "embeddings"), "vec_id", "embedding")


def op12_ranked(spark: SparkSession, sf: str) -> DataFrame:
    from dyadica.llm.ranked import search

    return search(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op13_tiktoken(spark: SparkSession, sf: str) -> DataFrame:
    from dyadica.llm.rank_bpe import encode_documents

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    return encode_documents(read(spark, sf, "documents"), path, split_pattern(), ["doc_id"], ids=False, decoded=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_language": op2_language,
    "op3_sketch": op3_sketch,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_lattice": op7_lattice,
    "op8_entropy_mix": op8_entropy_mix,
    "op9_licences": op9_licences,
    "op10_forest": op10_forest,
    "op11_whitening": op11_whitening,
    "op12_ranked": op12_ranked,
    "op13_tiktoken": op13_tiktoken,
}
