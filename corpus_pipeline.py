"""The corpus pipeline: quality rules, line dedup, near-dedup, source mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. The last returns doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids.

Defined results for odd input in every stage: a null text is empty (the rules reject it, as it has
too few words); a null doc_id, lang or source stays null; repeated rows are documents of their own,
but for the near-duplicate stage, which keeps one of them, and the line stage, which treats them
alike; an empty table gives an empty table; further columns pass through all stages but the last.
"""

from pagewright.llm import bpe, line_dedup, minhash_dedup, quality_rules, source_mixing
from pagewright.llm.common import materialise


def quality_stage(spark, docs, sf_dir):
    """Documents that the rules or their host's verdict reject go."""
    return quality_rules.keep_good(docs)


def line_stage(spark, docs, sf_dir):
    """Lines within one edit of an earlier line go, short ones if equal to one; n_chars follows the text. No document goes."""
    return line_dedup.dedup_lines(docs, length_col="n_chars").select(*docs.columns)


def near_stage(spark, docs, sf_dir):
    """Of documents with a similarity of 0.8 or more on five-word shingles one stays."""
    return minhash_dedup.keep_one(docs, size=5, percent=80)


def mixing_stage(spark, docs, sf_dir):
    """Nine tenths of the tokens, dealt by domain, language and source; each document once at most."""
    keys, weights = source_mixing.source_tree()
    return source_mixing.take(docs, keys, weights, budget=(9, 10), max_epochs=1, seed=20, length_col="n_chars")


def token_stage(spark, docs, sf_dir):
    """Token ids of every document left. Workers that served other stages remember fewer chunks."""
    return bpe.encode_documents(docs, bpe.default_vocabulary(), memory_chunks=150_000, decoded=False)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("bpe", token_stage),
]

#: The last stage's tokens have no SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
