"""The queries of the operators, over the whole given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlens.llm import (
    alignment,
    brown,
    hamming_join,
    hard_negatives,
    kneser_ney,
    line_runs,
    merge_automaton,
    packing,
    piece_table,
    pstable,
    rans,
    spotsigs,
    warc,
)
from learnlens.llm.shared import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """A vocabulary file of the public tokenizers; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents")


def op1_brown_scores(spark: SparkSession, folder: str) -> DataFrame:
    return brown.score(_documents(spark, folder), Scratch(spark, "brown"))


def op2_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.edited_pairs(_documents(spark, folder), Scratch(spark, "spotsigs"))


def op3_kneser_ney_quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = _table(spark, folder, "labels")
    return kneser_ney.judged(_documents(spark, folder), labels, Scratch(spark, "kneser-ney"))


def op4_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = _documents(spark, folder).select("doc_id", "text")
    done = line_runs.deduplicate(documents, Scratch(spark, "line-runs"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_piece_table(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    return piece_table.digests(_documents(spark, folder), Scratch(spark, "pieces"), model)


def op6_hamming_join(spark: SparkSession, folder: str) -> DataFrame:
    near = hamming_join.Near(words=4)
    return hamming_join.near_duplicates(_documents(spark, folder), Scratch(spark, "near"), near)


def op7_pstable_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = _table(spark, folder, "embeddings")
    asks = F.col("vec_id") % 50 == 0
    return pstable.nearest(embeddings, Scratch(spark, "nearest"), asks)


def op8_linear_grouping(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(
        _documents(spark, folder), Scratch(spark, "packing"), tokenizer("byte_bpe_50k.json"), keep_table=True
    )


def op9_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"), Scratch(spark, "warc"))


def op10_rans_ids(spark: SparkSession, folder: str) -> DataFrame:
    files = rans.write_ids(
        _documents(spark, folder), Scratch(spark, "rans"), tokenizer("word_bpe_49k.json"), "blanks"
    )
    return rans.read_ids(files)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    asks = F.col("vec_id") % 100 == 0
    return hard_negatives.mine(_table(spark, folder, "embeddings"), Scratch(spark, "negatives"), asks, moved)


def op12_merge_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return merge_automaton.digests(
        _documents(spark, folder), Scratch(spark, "automaton"), tokenizer("word_bpe_49k.json")
    )


def op13_pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(
        _documents(spark, folder),
        Scratch(spark, "alignment"),
        tokenizer("byte_bpe_50k.json"),
        tokenizer("piece_bpe_32k.model"),
    )


def registered() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_brown_scores,
            op2_spot_signatures,
            op3_kneser_ney_quality,
            op4_line_runs,
            op5_piece_table,
            op6_hamming_join,
            op7_pstable_neighbours,
            op8_linear_grouping,
            op9_warc_round_trip,
            op10_rans_ids,
            op11_hard_negatives,
            op12_merge_automaton,
            op13_pair_counts,
        )
    }


# What the keys, shingles and payloads of the operators are, said in SQL.
_LINES = """
lines AS (
    SELECT doc_id, generate_subscripts(ls, 1) AS place, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
),
keyed AS (
    SELECT *, translate(
        regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
),
owners AS (
    SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) > 1
),
marked AS (
    SELECT k.doc_id, k.place, k.line, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone
    FROM keyed k LEFT JOIN owners o ON k.key = o.key AND length(k.key) >= 10
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_runs": f"""
            WITH {_LINES}
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
            FROM marked GROUP BY doc_id
        """,
        "op6_hamming_join": """
            WITH RECURSIVE words AS (
                SELECT doc_id, regexp_extract_all(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\\x20\\x09-\\x0D]+') AS w
                FROM documents
            ),
            shingles AS (
                SELECT DISTINCT doc_id, unnest(CASE
                    WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
                    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                END) AS s
                FROM words
            ),
            sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
            shared AS (
                SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
                FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
            ),
            links AS (
                SELECT s.a, s.b FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id
                WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)
            ),
            both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
            reached AS (
                SELECT doc_id, doc_id AS other FROM documents
                UNION
                SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON r.other = e.a
            )
            SELECT d.doc_id, CAST(coalesce(any_value(z.n), 0) AS BIGINT) AS n_shingles,
                min(r.other) AS component_id, min(r.other) = d.doc_id AS kept
            FROM documents d JOIN reached r ON r.doc_id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
            GROUP BY d.doc_id
        """,
        "op9_warc_round_trip": """
            WITH payloads AS (
                SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
                    sha1(coalesce(html, '')) AS payload_digest
                FROM pages
            ),
            firsts AS (
                SELECT payload_digest, max(page_id) AS first FROM payloads
                WHERE payload_bytes >= 1000 GROUP BY payload_digest
            )
            SELECT p.page_id, p.payload_bytes, p.payload_digest,
                CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
                CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
            FROM payloads p LEFT JOIN firsts f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 1000
        """,
        "op11_hard_negatives": """
            WITH vectors AS (
                SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
                FROM embeddings
                WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ),
            scored AS (
                SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
                    CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
                FROM vectors a JOIN vectors r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
            ),
            positives AS (
                SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
                QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
            )
            SELECT p.anchor_id, positive_id,
                CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
                    AS INTEGER) AS rank,
                n.vec_id AS negative_id, positive_score, n.score AS negative_score
            FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
                AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
            QUALIFY rank <= 10
        """,
    }
