"""The registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from urna.llm import (
    bpe,
    codes,
    decontaminate,
    extract,
    mixing,
    neighbours,
    quality,
    resample,
    shards,
    simhash,
    substring,
    tokencount,
    warc,
)
from urna.llm.common import new_folder, read

#: Path of the rank file; a parameter of the operator.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Name of the model file whose tokens are counted.
PIECES = "piece_bpe_32k.model"


def vocabulary() -> tuple[str, str]:
    """Path of the public rank file and the pattern it goes with."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(read(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(read(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return warc.read(archives, payloads=False).drop("payload", "url")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), *vocabulary())


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score_documents(read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes(read(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_sharding": op3_sharding,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_warc": op6_warc,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_context_mixing": op9_context_mixing,
    "op10_simhash": op10_simhash,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_counts": op12_token_counts,
    "op13_importance_resampling": op13_importance_resampling,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D ]+'), lambda x: x <> '')"



def _lloyd(rounds: int = 4) -> str:
    """Plain Lloyd rounds: every part is compared with every entry in every round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        near{r} AS MATERIALIZED (
            SELECT v.n, v.p, min((list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) ** 2))::BIGINT, b.e)) AS best
            FROM part v JOIN book{r} b USING (p) GROUP BY v.n, v.p
        )""".replace("min((", "min(row(").replace(" ** 2", " * (v.x[i] - b.x[i])"))
        if r < rounds:
            steps.append(f"""
        mean{r} AS MATERIALIZED (
            SELECT p, e, list(floor_ ORDER BY i) AS x
            FROM (
                SELECT p, e, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_
                FROM (SELECT n, p, best[2] AS e FROM near{r}) JOIN long USING (n, p) GROUP BY p, e, i
            ) GROUP BY p, e
        ),
        book{r + 1} AS MATERIALIZED (
            SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m USING (p, e)
        )""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label,
                   list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ),
        part AS MATERIALIZED (
            SELECT n, p, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4] AS x
            FROM kept CROSS JOIN (SELECT unnest(range(4)) AS p)
        ),
        long AS MATERIALIZED (SELECT n, p, unnest(x)::HUGEINT AS x, generate_subscripts(x, 1) AS i FROM part),
        book0 AS MATERIALIZED (SELECT p, n - 1 AS e, x::HUGEINT[] AS x FROM part WHERE n <= 256),
        {",".join(steps)},
        coded AS (
            SELECT n, string_agg(printf('%02x', best[2]::BIGINT), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error
            FROM near{rounds} GROUP BY n
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
        FROM kept JOIN coded USING (n)
    """


#: CRC-32 byte by byte over the hexadecimal form of a feature, with the table of its 256 steps.
_CRC = """
    xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))
"""

_DRAW = f"""
    WITH RECURSIVE steps(n, k, c) AS (
        SELECT range, 0, range::BIGINT FROM range(256)
        UNION ALL
        SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM steps WHERE k < 8
    ),
    crc AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
    texts AS MATERIALIZED (
        SELECT 'd' AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        UNION ALL
        SELECT 'b', row_number() OVER (), NULL, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
    ),
    runs AS MATERIALIZED (
        SELECT side, r, feature, count(*) AS n FROM (
            SELECT side, r, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(
                range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i : i + k - 1], ' '))))) AS feature
            FROM texts
        ) GROUP BY ALL
    ),
    buckets AS MATERIALIZED (
        SELECT feature, ({_CRC})::BIGINT % 10000 AS bucket
        FROM (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM runs)), crc
    ),
    sides AS (
        SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
        FROM runs JOIN buckets USING (feature) GROUP BY bucket
    ),
    gain AS MATERIALIZED (
        SELECT bucket, floor(1000 * ln(
            (t::DOUBLE + 1) * ((SELECT sum(s) FROM sides)::DOUBLE + 10000)
            / ((s::DOUBLE + 1) * ((SELECT sum(t) FROM sides)::DOUBLE + 10000))))::BIGINT AS g FROM sides
    ),
    weights AS (
        SELECT r, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight
        FROM runs JOIN buckets USING (feature) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r
    ),
    scores AS (
        SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + floor(-1000 * ln(-ln((
                   ('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
        FROM texts LEFT JOIN weights USING (r) WHERE side = 'd'
    ),
    ordered AS (
        SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
               sum((n_words >= 20)::INT) OVER () AS able FROM scores
    )
    SELECT doc_id, n_features, weight, score,
           CASE WHEN n_words >= 20 AND place <= able * 5 // 100 THEN place END AS rank FROM ordered
"""

ORACLE: dict[str, str] = {
    "op1_substring_dedup": f"""
        WITH doc AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        win AS (
            SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM doc)
        ),
        early AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
        gone AS (
            SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p
            FROM win JOIN early USING (k) WHERE doc_id > f
        ),
        cut AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
        whole AS (SELECT doc.doc_id, words, coalesce(ps, []) AS ps FROM doc LEFT JOIN cut USING (doc_id))
        SELECT doc_id, len(words) AS n_words, len(ps) AS n_removed,
               sha256(array_to_string(
                   list_filter(words, lambda x, i: NOT list_contains(ps, i)), ' ')) AS kept_sha256
        FROM whole
    """,
    "op11_vector_codes": _lloyd(),
    "op13_importance_resampling": _DRAW,
}
