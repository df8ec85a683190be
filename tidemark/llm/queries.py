"""Registered queries of this package, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    byte_bpe,
    chat_format,
    exact_dedup,
    importance,
    language_id,
    mixing,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    token_alignment,
    token_counts,
    url_filter,
)
from tidemark.llm.common import table
from tidemark.session import pin_utc


def _documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    pin_utc(spark)
    return table(spark, folder, "documents").select(*columns)


def mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder, "doc_id", "source", "text")
    return mixing.with_copies(docs, columns=[]).select("doc_id", "size", "source_size", "target", "taken")


def judged_urls(spark: SparkSession, folder: str) -> DataFrame:
    pin_utc(spark)
    model = url_filter.fit_labelled(url_filter.labelled_urls(spark))
    judged = url_filter.judge(table(spark, folder, "pages").select("page_id", "url"), model)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def sharded_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder, "doc_id", "text")
    return sharding.shard(docs, columns=["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.classes(_documents(spark, folder, "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.groups(_documents(spark, folder, "doc_id", "text"))


def tokenizer(spark: SparkSession, path: str | None = None) -> byte_bpe.Tokenizer:
    return byte_bpe.Tokenizer(spark, path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def found_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(_documents(spark, folder, "doc_id", "text"), secret_scan.fit(), columns=["doc_id"])

    def number(kind: str):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def shown(spans):
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    base = F.filter("findings", lambda f: f["kind"].isin(*secret_scan.BASE))
    return found.select(
        "doc_id",
        *[number(kind) for kind in secret_scan.BASE],
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"),
        shown(F.filter("findings", lambda f: f["kept"])).alias("spans"),
    )


def edited_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts before and after three edits of every document: a deletion, an insertion, a new ending."""
    coder = tokenizer(spark)
    n = F.length("text")
    edit = lambda start, end, text: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(text).alias("text"))
    edits = F.array(edit(n / 4, n / 4 + 10, ""), edit(n / 2, n / 2, " it's 42\n\n new"), edit(n - 5, n + 99, "  end."))
    docs = _documents(spark, folder, "doc_id", "text").withColumn("edits", edits)
    after = token_counts.build_and_edit(docs, coder, columns=["doc_id"])
    return after.select(
        "doc_id",
        "n_tokens",
        token_counts.total().alias("n_tokens_edited"),
        F.length("text").alias("n_chars_edited"),
        "split_chars",
        F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"),
    )


def encoded_documents(spark: SparkSession, folder: str) -> DataFrame:
    coded = byte_bpe.encode(_documents(spark, folder, "doc_id", "text"), tokenizer(spark))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def formatted_conversations(spark: SparkSession, folder: str) -> DataFrame:
    pin_utc(spark)
    text = "</s>[INST] ok [/INST]"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = [F.struct(*[F.lit(v).cast(k) for v, k in zip((-7, i, r, text), ("long", "long", "string", "string"))]) for i, r in enumerate(("user", "assistant"))]
    names = ["conv_id", "turn", "role", "text"]
    extra = spark.range(1).select(F.explode(F.array(*probe)).alias("r")).select(*[F.col("r")[f"col{i + 1}"].alias(n) for i, n in enumerate(names)])
    back = chat_format.read_back(chat_format.examples(rows.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def judged_documents(spark: SparkSession, folder: str) -> DataFrame:
    book = quality_rules.ledger(_documents(spark, folder, "doc_id", "text"), columns=["doc_id"])
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality_rules.passes(1)).alias("base_failed"),
        quality_rules.passes(quality_rules.CURRENT).alias("kept"),
    )


def resampled_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder, "doc_id", "text")
    drawn = importance.resample(docs, table(spark, folder, "benchmark").select("text"), columns=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def identified_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder, "doc_id", "text", "lang")
    held_out = language_id.held_out(F.col("doc_id"))
    net = language_id.fit(docs.filter(~held_out))
    return language_id.identify(docs, net, columns=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def aligned_tokens(spark: SparkSession, folder: str) -> DataFrame:
    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_alignment.align(_documents(spark, folder, "doc_id", "text"), token_alignment.Tokenizers(spark, *files), columns=["doc_id"])


QUERIES = {
    "op1_mixed_sources": mixed_sources,
    "op2_judged_urls": judged_urls,
    "op3_sharded_documents": sharded_documents,
    "op4_found_secrets": found_secrets,
    "op5_near_copies": near_copies,
    "op6_exact_copies": exact_copies,
    "op7_edited_token_counts": edited_token_counts,
    "op8_encoded_documents": encoded_documents,
    "op9_formatted_conversations": formatted_conversations,
    "op10_judged_documents": judged_documents,
    "op11_resampled_documents": resampled_documents,
    "op12_identified_languages": identified_languages,
    "op13_aligned_tokens": aligned_tokens,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op1_mixed_sources": rf"""
        WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size,
                          CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS k FROM documents),
        s AS (SELECT k, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k, source),
        r AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS w,
                     3 * source_size AS cap FROM s),
        l AS (SELECT *, row_number() OVER o AS rank,
                     CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
                     / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
              FROM r WINDOW o AS (ORDER BY cap::DOUBLE / w, source IS NULL, source),
                            b AS (ORDER BY cap::DOUBLE / w, source IS NULL, source
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT *, coalesce(least(w * (SELECT level FROM l WHERE level * w <= cap ORDER BY rank LIMIT 1), cap::DOUBLE), 0) AS target FROM l),
        e AS (SELECT *, CAST(floor(coalesce(target / nullif(source_size, 0), 0) * 1099511627776) AS BIGINT) AS each_,
                     CAST('0x' || substr(md5('mix:' || k), 1, 10) AS BIGINT) AS off FROM t),
        p AS (SELECT doc_id, size, source_size, target, each_,
                     (CAST(row_number() OVER (PARTITION BY d.k ORDER BY size, doc_id) - 1 AS HUGEINT) * each_ + off) % 1099511627776 AS before
              FROM d JOIN e ON d.k = e.k)
        SELECT doc_id, size, source_size, target, CAST((before + each_) // 1099511627776 AS BIGINT) * size AS taken FROM p
    """,
    "op6_exact_copies": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op9_formatted_conversations": r"""
        WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        shown AS (SELECT *, length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g'))
                            + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) + 24 AS chars FROM rows),
        sums AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
                        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM shown)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(upto) FILTER (role = 'assistant' OR last)::BIGINT AS formatted_chars
        FROM sums GROUP BY conv_id
    """,
    "op10_judged_documents": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
        lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
        dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
                WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
        twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
        rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
        m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
              FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > n_words OR (n_lines >= 3 AND 100 * n_dup_lines > 40 * n_lines)
                    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
        FROM b
    """,
    "op11_resampled_documents": r"""
        WITH RECURSIVE bits AS (SELECT b, 0 AS i, b::BIGINT AS c FROM range(256) r(b)
                       UNION ALL SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE i < 8),
        crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE i = 8),
        texts AS (SELECT 0 AS side, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark),
        w AS (SELECT side, row_number() OVER () AS r, doc_id,
                     regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        runs AS (SELECT side, r, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT side, r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(1, 4) k(n) WHERE len(w) >= n)),
        each AS (SELECT side, r, g, count(*) AS n FROM runs GROUP BY ALL),
        hashed AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(g)), lambda i: ('0x' || substr(hex(g), 2 * i + 1, 2))::BIGINT)),
                                     lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
                   FROM (SELECT DISTINCT g FROM each), crc),
        f AS (SELECT side, r, bucket, sum(n) AS n FROM each JOIN hashed USING (g) GROUP BY ALL),
        b AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM f GROUP BY bucket),
        gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM b),
        d AS (SELECT w.r, doc_id, len(w) AS n_words, coalesce(sum(n), 0)::BIGINT AS n_features, coalesce(sum(n * gain), 0)::BIGINT AS weight
              FROM w LEFT JOIN f ON w.r = f.r LEFT JOIN gain USING (bucket) WHERE w.side = 0 GROUP BY w.r, doc_id, len(w)),
        e AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
        o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM e)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM o
    """,
}
