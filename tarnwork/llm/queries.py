"""Queries of the operators on training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwork.llm.pii import find_personal, mask_personal
from tarnwork.llm.conversations import conversations
from tarnwork.llm.packing import Capacities, checks, pack
from tarnwork.llm.subjects import assign_subjects, corpus_composition
from tarnwork.llm.splitting import piece_checks, split_blocks
from tarnwork.llm.tokens import encode_corpus, token_counts
from tarnwork.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations of the review runs as ordered messages."""
    return conversations(table(spark, sf_dir, "sdk_review"))


def p2_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`p2_found` with every conversation treated by distributed star joins and contraction."""
    return conversations(table(spark, sf_dir, "sdk_review"), limit=0)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal items in the text fields of transcripts."""
    return find_personal(table(spark, sf_dir, "transcript_lines"))


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text fields of transcripts with placeholders in place of personal items."""
    return mask_personal(table(spark, sf_dir, "transcript_lines"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note blocks that the splitter cuts."""
    return split_blocks(table(spark, sf_dir, "note_blocks")).filter("piece_no = 1 AND n_pieces > 1").select("block_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All note blocks as pieces within the limit."""
    return split_blocks(table(spark, sf_dir, "note_blocks"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of every text or piece."""
    return pack(table(spark, sf_dir, "documents"))


#: Capacities that all bind: at most 12 texts of a container, and attention of one full text of 1,549 tokens.
VECTOR = Capacities(documents=12, attention=2_400_000, weights=(1.0, 0.5, 0.5))


def p7_packed_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of every text or piece where tokens, texts and attention of a container are limited."""
    return pack(table(spark, sf_dir, "documents"), capacities=VECTOR)


def p7_checks(spark: SparkSession, sf_dir: str, capacities: Capacities = VECTOR) -> DataFrame:
    """Whether the containers of `p7_packed_vector` keep every capacity and hold every token once."""
    documents = table(spark, sf_dir, "documents")
    return checks(pack(documents, capacities=capacities), token_counts(documents), capacities)


def p5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of `p5_pieces` keep the limit and leave nothing out, one row over all blocks."""
    blocks = table(spark, sf_dir, "note_blocks")
    return piece_checks(split_blocks(blocks), blocks)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas of every document."""
    return assign_subjects(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subjects")))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of every subject in the corpus."""
    return corpus_composition(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subjects")))


QUERIES = {"p2_found": p2_found, "p2_rounds": p2_rounds, "p3_found": p3_found, "p3_masked": p3_masked, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_ids": p6_ids, "p7_packed": p7_packed, "p7_packed_vector": p7_packed_vector, "p7_checks": p7_checks, "p7_token_checks": lambda s, d: p7_checks(s, d, Capacities()), "p5_checks": p5_checks, "p8_found": p8_found, "p8_composition": p8_composition}
