"""One query per operator, over whole tables, and the SQL of those that SQL can state.

What each does with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns is what the
operator that it calls says of itself: a query reads its table whole, picks the operator's columns and adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import chat, decontaminate, importance, language, least_squares, packing, quality, shared, simhash, substrings, surrogates, token_blocks, warc


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_files(spark, shared.documents(spark, sf_dir)).drop("shard")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is in no fold, and so not held out."""
    docs = shared.documents(spark, sf_dir)
    found = language.identify(shared.text_only(docs, "doc_id", "text"), language.train(docs), without=("text",))
    held_out = F.coalesce(language.fold() == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "cross_entropy", "rejected")


def op3_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.text_only(shared.documents(spark, sf_dir), "doc_id", "text")
    found = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), without=("text",))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty table leaves conversation -1."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    extra = [spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text")) for k, role in enumerate(("user", "assistant"))]
    made = chat.formatted(chat.canonical(rows.unionByName(extra[0]).unionByName(extra[1])))
    back = chat.read_back(made.withColumn("formatted_chars", F.length("formatted").cast("long")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op5_pivot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(shared.documents(spark, sf_dir))


def op6_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.strip(shared.documents(spark, sf_dir)).drop("text")


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.anonymise(shared.text_only(shared.documents(spark, sf_dir), "doc_id", "text"), surrogates.session_key(spark))
    return found.select("doc_id", F.size("entities").cast("long").alias("n_entities"), "text", "entities")


def op8_split_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_and_read(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quantile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(shared.documents(spark, sf_dir)).drop("lang", "source", *quality.RATES)


def op10_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark, shared.documents(spark, sf_dir))


def op11_duckdb_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return least_squares.packed(spark, shared.documents(spark, sf_dir))


QUERIES = {
    "op1_token_blocks": op1_token_blocks,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_aho_corasick": op3_aho_corasick,
    "op4_schema_fingerprint": op4_schema_fingerprint,
    "op5_pivot_tables": op5_pivot_tables,
    "op6_doubling": op6_doubling,
    "op7_surrogates": op7_surrogates,
    "op8_split_reader": op8_split_reader,
    "op9_quantile_sketches": op9_quantile_sketches,
    "op10_linear_grouping": op10_linear_grouping,
    "op11_duckdb_buckets": op11_duckdb_buckets,
    "op12_least_squares": op12_least_squares,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SPACE = "[\\x20\\x09-\\x0D]"
_RATES = quality.RATES


def _quality_sql() -> str:
    bins = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {r} AS v FROM rated WHERE NOT base_failed AND {r} IS NOT NULL" for r in _RATES)
    e = "greatest(length(bin(v)) - 6, 0)"
    up = "greatest(bin // 32 - 1, 0)"
    tail = quality.TAIL

    def quantiles(name: str, keys: str) -> str:
        return f"""
        {name} AS (
            SELECT {keys} rate, max(total) AS rows, min(CASE WHEN upto * 1000 >= 250 * total THEN top END) AS q1,
                   min(CASE WHEN upto * 1000 >= 750 * total THEN top END) AS q3,
                   min(CASE WHEN upto * 1000 >= {1000 - tail} * total THEN top END) AS high, min(CASE WHEN upto * 1000 > {tail} * total THEN bottom END) AS low
            FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} rate ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {keys} rate) AS total,
                         ((bin - 32 * {up} + 1) << {up}) - 1 AS top, (bin - 32 * {up}) << {up} AS bottom
                  FROM (SELECT {keys} rate, bin, sum(n) AS n FROM binned GROUP BY ALL))
            GROUP BY ALL),"""

    pick = lambda q: f"CASE WHEN o.rows >= {quality.LEAST_ROWS} THEN o.{q} WHEN l.rows >= {quality.LEAST_ROWS} THEN l.{q} ELSE a.{q} END AS {q}"
    good = " AND ".join([f"{r} <= most_{r}" for r in _RATES] + ["word_length >= least_word_length"])
    width = f"{quality.FENCE} * (q3 - q1)"
    most, least = f"CASE WHEN q3 > q1 THEN least(high, q3 + {width}) ELSE high END", f"CASE WHEN q3 > q1 THEN greatest(low, q1 - {width}) ELSE low END"
    limits = ", ".join([f"max(CASE WHEN rate = '{r}' THEN {most} END) AS most_{r}" for r in _RATES] + [f"max(CASE WHEN rate = 'word_length' THEN {least} END) AS least_word_length"])
    return rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents),
        grams AS (SELECT r, i, (w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
        twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
        covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
        counted AS (
            SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
            FROM docs LEFT JOIN covered USING (r)),
        rated AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                   CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words END AS symbol_rate,
                   CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines END AS dup_line_rate,
                   CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words END AS repeat_rate,
                   CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words END AS word_length
            FROM counted),
        binned AS (SELECT lang, source, rate, 32 * {e} + (v >> {e}) AS bin, count(*) AS n FROM ({bins}) GROUP BY ALL),
        {quantiles("own", "lang, source,")}{quantiles("by_lang", "lang,")}{quantiles("every", "")}
        picked AS (
            SELECT o.lang, o.source, o.rate, {", ".join(map(pick, ("q1", "q3", "high", "low")))}
            FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rate = l.rate JOIN every a ON o.rate = a.rate),
        limits AS (SELECT lang, source, {limits} FROM picked GROUP BY ALL)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({good}, true) AS kept
        FROM rated t LEFT JOIN limits m ON t.lang IS NOT DISTINCT FROM m.lang AND t.source IS NOT DISTINCT FROM m.source"""


def _escaped(text: str) -> str:
    return rf"regexp_replace(replace({text}, '\', '\\'), '(<)(\||/?s>|</?SYS>>|/SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"


#: CRC-32 of f's UTF-8 bytes: a byte at a time, the polynomial's table made by the rule.
_CRC = """
        steps AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
        hashed AS (
            SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda k: ('0x' || hex(encode(f))[2 * k + 1:2 * k + 2])::BIGINT),
                                      lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS b
            FROM (SELECT DISTINCT f FROM features), steps),"""


def _resampling_sql() -> str:
    return rf"""
        WITH texts AS (
            SELECT true AS wanted, row_number() OVER () AS r, NULL::BIGINT AS doc_id, text FROM benchmark
            UNION ALL SELECT false, row_number() OVER (), doc_id, text FROM documents),
        listed AS (SELECT *, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
        placed AS (SELECT wanted, r, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
        features AS (
            SELECT wanted, r, f, count(*) AS n
            FROM (SELECT wanted, r, w[i] AS f FROM placed UNION ALL SELECT wanted, r, w[i] || ' ' || w[i + 1] FROM placed WHERE i < len(w)) GROUP BY ALL),{_CRC}
        counted AS (SELECT wanted, r, b, sum(n) AS n FROM features JOIN hashed USING (f) GROUP BY ALL),
        totals AS (SELECT coalesce(sum(n) FILTER (NOT wanted), 0)::DOUBLE AS s_all, coalesce(sum(n) FILTER (wanted), 0)::DOUBLE AS t_all FROM counted),
        gains AS (
            SELECT b, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain
            FROM (SELECT b, coalesce(sum(n) FILTER (NOT wanted), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (wanted), 0)::DOUBLE AS t FROM counted GROUP BY b), totals),
        weighed AS (SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS g FROM counted JOIN gains USING (b) WHERE NOT wanted GROUP BY r),
        scored AS (
            SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
                   ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT AS h
            FROM listed LEFT JOIN weighed USING (r) WHERE NOT wanted),
        final AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
        ranked AS (
            SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS rank, count(*) OVER () AS able
            FROM final WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * able // 100 THEN rank END AS rank
        FROM final LEFT JOIN ranked USING (r)"""


ORACLE_SQL = {
    "op11_duckdb_buckets": _resampling_sql(),
    "op4_schema_fingerprint": f"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(k))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum({len(chat.TURN + chat.TEXT + chat.END)} + length({_escaped("role")}) + length({_escaped("text")}))::BIGINT AS formatted_chars
        FROM rows GROUP BY conv_id""",
    "op6_doubling": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
        twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1),
        covered AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM twice)),
        placed AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT a.r, string_agg(word, ' ' ORDER BY a.p) AS t, count(*) AS n FROM placed a LEFT JOIN covered c ON a.r = c.r AND a.p = c.p WHERE c.p IS NULL GROUP BY a.r)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)""",
    "op8_split_reader": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
        m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS leader FROM p)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN leader IS NULL OR leader IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN leader IS DISTINCT FROM page_id THEN leader END AS refers_to
        FROM m""",
    "op9_quantile_sketches": _quality_sql(),
    "op3_aho_corasick": rf"""
        WITH items AS (
            SELECT coalesce(item_id::VARCHAR, 'null') AS item,
                   regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE text IS NOT NULL),
        windows AS (
            SELECT DISTINCT item, least(13, len(w)) AS l, array_to_string(w[i:i + 12], ' ') AS g
            FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0)),
        docs AS (
            SELECT row_number() OVER () AS r, doc_id,
                   coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
            FROM documents),
        lengths AS (SELECT DISTINCT l FROM windows),
        grams AS (
            SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS g
            FROM (SELECT r, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM docs, lengths)),
        found AS (SELECT r, i, l, item FROM grams JOIN windows USING (l, g)),
        hits AS (
            SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM found) GROUP BY r),
        named AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)""",
}
