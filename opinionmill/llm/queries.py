"""One query for each operator over its whole table, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, collocations, dialogues, html_text, language, packing, quality, repeats, rules, sharding, simhash, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.repair_damage(table(spark, sf_dir, "conversations"))


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op")}


TOP_SCORES = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS vec FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM p QUALIFY rank <= 20"""


PHRASES = r"""
    WITH words AS (
      SELECT lang, [x FOR x IN string_split_regex(piece_text, '[ \t]+') IF x <> ''] AS w
      FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'
            )) AS piece_text FROM documents)),
    sized AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS size FROM words WHERE len(w) > 0),
    counts AS (
      SELECT lang, size, phrase, count(*) AS n
      FROM (SELECT lang, size, unnest([array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS phrase FROM sized)
      GROUP BY lang, size, phrase),
    totals AS (SELECT lang, sum(n)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
    cand AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND n >= 30),
    cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
    scored AS (
      SELECT c.lang, c.phrase, c.a, c.size, c.k, f.n AS l, r.n AS r, ((2000000::HUGEINT * c.a) // (f.n + r.n))::BIGINT AS score
      FROM cuts c JOIN counts f ON f.lang = c.lang AND f.phrase = array_to_string(c.w[1:c.k], ' ')
      JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_ AS (
      SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, w, m, a, unnest(range(1, size - m + 2)) AS i FROM (SELECT lang, w, size, a, unnest(range(2, size)) AS m FROM cand))
      GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM best LEFT JOIN inner_ USING (lang, phrase) JOIN totals USING (lang)
    WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
    QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """The other operators are beyond SQL, or too slow in it on whole tables; the tests hold them against brute force."""
    return {"op7_topk": TOP_SCORES, "op13_collocations": PHRASES}
