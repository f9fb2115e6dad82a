"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bytepairs, chat, licenses, lm, minhash, mixing, pieces, quality_classifier, quality_rules, repair, spelling, warc


#: The contract of op4_near_duplicates.
_OP4_PERCENT = 85


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs, carry=["doc_id"]).select("__row.doc_id", "source", "lang", "topic", "tokens", "probability", "selected")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))]))
    )
    out = chat.format_chats(turns.unionByName(extra)).withColumns(
        {"turns": chat.read_back(F.col("formatted")), "learned": chat.masked_text(F.col("formatted"), F.col("loss_spans"))}
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model, carry=["doc_id"]).select("__row.doc_id", "score")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=_OP4_PERCENT)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id"])
    return out.select("__row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def _damaged(records: DataFrame) -> DataFrame:
    """A replica with records lost, cut short and overwritten, chosen by page id; what follows a cut moves up."""
    page = F.coalesce("page_id", F.lit(0))
    short = F.expr("substring(payload, 1, greatest(0, octet_length(payload) - 7))")
    overwritten = F.overlay("payload", F.lit(b"\x00"), 20)
    payload = F.when(page % 193 == 7, short).when(page % 97 == 13, overwritten).otherwise(F.col("payload"))
    return records.filter(page % 211 != 5).withColumn("payload", payload)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.warc_records(_table(spark, sf_dir, "pages"))
    return warc.audit(records, _damaged(records))


def _paths(docs: DataFrame) -> DataFrame:
    """Documents as files: every tenth one level up, every hundredth two."""
    k = F.col("doc_id")
    tops = [F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))]
    tail = F.concat(k.cast("string"), F.lit(".txt"))
    near, far = F.floor(k / 200).cast("string"), F.floor(k / 4000).cast("string")
    deep = F.concat_ws("/", *tops, far, near, tail)
    path = F.when(k % 100 == 0, F.concat_ws("/", *tops, tail)).when(k % 10 == 0, F.concat_ws("/", *tops, far, tail)).otherwise(deep)
    return docs.select("doc_id", F.when(k.isNotNull(), path).alias("path"), "text")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_paths(_table(spark, sf_dir, "documents")))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    judged = quality_rules.judge(docs, carry=["doc_id"])
    return judged.select("__row.doc_id", "__rules.*", "base_failed", F.round("host_rate", 9).alias("host_rate"), "kept")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Conversations with rows lost, emptied, stripped of sentence ends, doubled or given the role user, chosen by conversation and turn.

    ``copies`` is 0 for a lost row and 2 for a doubled one. Nulls are one space.
    """
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1])) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = repair.repair(damaged_turns(_table(spark, sf_dir, "conversations")), copies=F.col("copies"))
    return fixed.select(*[c for c in fixed.columns if c != "repaired"], F.sha2("repaired", 256).alias("repaired_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bytepairs.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, carry=["doc_id"])
    return out.select("__row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_mixing, op2_chat, op3_quality_classifier, op4_near_duplicates, op5_sentencepiece,
        op6_ann, op7_warc, op8_licenses, op9_lm, op10_quality_rules,
        op11_spelling, op12_repair, op13_byte_bpe,
    )
    return {f.__name__: f for f in found}


_OP2_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(replace(text, '␛', '␛e'), '(<|\\[)(/?s>|/?ROLE\\]|SEP\\]|/?INST\\]|</?SYS>>|\\|im_start\\|>|\\|im_end\\|>)', '\\1␛\\2', 'g')) AS chars,
    length(regexp_replace(replace(role, '␛', '␛e'), '(<|\\[)(/?s>|/?ROLE\\]|SEP\\]|/?INST\\]|</?SYS>>|\\|im_start\\|>|\\|im_end\\|>)', '\\1␛\\2', 'g')) AS role_chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN before IS NOT DISTINCT FROM role THEN 5 ELSE 9 + role_chars + 7 + 4 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP7_HEAD = "WARC/1.0..WARC-Type: resource..WARC-Record-ID: <urn:uuid:00000000-0000-0000-0000-000000000000>..WARC-Date: 2020-01-01T00:00:00Z..WARC-Target-URI: "
_OP7_SQL = f"""
WITH p AS (
  SELECT page_id // 256 AS file, page_id,
    {len(_OP7_HEAD)} + strlen(coalesce(url, '')) + {len('..Content-Type: text/html..Content-Length: ')} + length(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + 4 + strlen(coalesce(html, '')) + 4 AS length
  FROM pages
), o AS (
  SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM p
), f AS (
  SELECT file, page_id, CASE WHEN page_id % 193 = 7 THEN length - 7 ELSE length END AS found_length FROM p WHERE page_id % 211 <> 5
), g AS (
  SELECT *, CAST(coalesce(sum(found_length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS found_offset FROM f
)
SELECT o.file, "offset", o.page_id, CAST(length AS BIGINT) AS length, found_offset, CAST(found_length AS BIGINT) AS found_length,
  CASE WHEN found_length IS NULL THEN 'missing' ELSE 'changed' END AS status
FROM o LEFT JOIN g ON o.page_id = g.page_id WHERE o.page_id % 211 = 5 OR o.page_id % 193 = 7 OR o.page_id % 97 = 13
"""


_OP4_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + {minhash.SHINGLE - 1}], chr(31)) AS shingle
  FROM w, unnest(range(1, greatest(len(ws) - {minhash.SHINGLE - 1}, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) + 1)) AS r(i)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= {_OP4_PERCENT} * (x.n + y.n - met)
), edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b),
groups AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM groups LEFT JOIN n USING (doc_id)
"""

_OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i : i + 7], chr(31))) AS times FROM d, unnest(range(1, greatest(len(ws) - 6, 1))) AS r(i)
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM win, unnest(range(8)) AS r(j) WHERE times > 1 GROUP BY doc_id
), f AS (
  SELECT doc_id, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)
), b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT count(*) AS hosts, sum(n) AS n, sum(f) AS f, sum(f * f / n) AS ff, sum(n * n) AS nn, (sum(f) + 0.5) / (sum(n) + 1.0) AS mean FROM h),
q AS (SELECT *, mean * (1 - mean) AS noise, n - nn / n - (hosts - 1) AS freedom, greatest(0, ff - f * f / n) AS spread FROM t),
p AS (SELECT mean, 1 / least(0.99, greatest(1e-4, CASE WHEN freedom > 0 THEN (spread - noise * (hosts - 1)) / (noise * freedom) ELSE 0.5 END)) - 1 AS strength FROM q),
v AS (SELECT source, (h.f + mean * strength) / (h.n + strength) AS rate, h.n + strength AS weight FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 9) AS host_rate,
  NOT base_failed AND NOT coalesce(rate - {quality_rules.HOST_Z} * sqrt(rate * (1 - rate) / (weight + 1)) > {quality_rules.HOST_LIMIT}, false) AS kept
FROM b LEFT JOIN v USING (source)
"""


def _op8_sql() -> str:
    idf, unknown, weights = licenses.template_weights()
    terms = ", ".join(f"('{t}', {x!r}::DOUBLE)" for t, x in idf.items())
    vectors = ", ".join(f"({i}, '{name}', '{t}', {x!r}::DOUBLE)" for i, name, t, x in weights)
    return f"""
WITH terms(term, idf) AS (VALUES {terms}), vectors(template, license, term, w) AS (VALUES {vectors}),
files AS (
  SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'),
    CASE WHEN doc_id % 100 <> 0 THEN doc_id // 4000 END, CASE WHEN doc_id % 10 <> 0 THEN doc_id // 200 END, doc_id || '.txt') AS path FROM documents
), lines AS (
  SELECT DISTINCT path, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, line, regexp_extract_all(lower(line), '{licenses.TERM}') AS found
  FROM files, unnest(string_split(text, chr(10))) AS l(line)
), bag AS (SELECT path, words, line, len(found) AS line_words, term, count(*) AS tf FROM lines, unnest(found) AS u(term) GROUP BY ALL),
x AS (SELECT bag.*, tf * coalesce(idf, {unknown!r}::DOUBLE) AS x FROM bag LEFT JOIN terms USING (term)),
norms AS (SELECT path, words, line, line_words, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
dots AS (SELECT path, words, line, line_words, template, license, sum(x * w) AS dot FROM x JOIN vectors USING (term) GROUP BY ALL),
scored AS (SELECT path, license, words > {licenses.FILE_WORDS} * line_words AS long, round(dot / norm, 6) AS score FROM dots JOIN norms USING (path, words, line, line_words)),
found AS (SELECT path, license, score, NOT long AS licence_file FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, license, long) AS r FROM scored WHERE score >= {licenses.LEAST_COSINE}) WHERE r = 1),
speaking AS (SELECT from_dir, license FROM (SELECT regexp_replace(path, '/?[^/]*$', '') AS from_dir, license, row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY score DESC, license, path) AS r FROM found WHERE licence_file) WHERE r = 1),
rows AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
near AS (SELECT dir, arg_max(s.from_dir, length(s.from_dir)) AS from_dir, arg_max(s.license, length(s.from_dir)) AS dir_license FROM (SELECT DISTINCT dir FROM rows) d JOIN speaking s ON s.from_dir = '' OR d.dir = s.from_dir OR starts_with(d.dir, s.from_dir || '/') GROUP BY dir)
SELECT doc_id, path, license, score, coalesce(licence_file, false) AS licence_file, coalesce(license, dir_license) AS effective,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN license IS NULL THEN from_dir END AS from_dir
FROM rows LEFT JOIN found USING (path) LEFT JOIN near USING (dir)
"""


def _crc32_table() -> list[int]:
    """The table of the checksum's usual polynomial, from its rule."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def _crc32_sql(numbers: str) -> str:
    """The checksum of a list of byte values."""
    table = "[" + ", ".join(map(str, _crc32_table())) + "]::BIGINT[]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda c, b: xor(c >> 8, ({table})[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::BIGINT)"


# Near words by the letters that they lose: words of one length are near if they are the same without one place, others if one is the other without a letter.
_OP11_SQL = f"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents),
l AS (SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM r GROUP BY ALL),
h AS (SELECT run, k, {_crc32_sql("flatten(list_transform(string_split(doc || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195::BIGINT, CAST(unicode(x) - 64 AS BIGINT)] END))")} AS h FROM l),
c AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
s AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS stem FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS other, b.n AS m FROM s a JOIN s b ON a.i = b.i AND a.stem = b.stem AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM s JOIN w ON s.stem = w.word
  UNION SELECT w.word, s.word, s.n FROM s JOIN w ON s.stem = w.word),
b AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, m FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN b ON b.word = w.word),
g AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON f.word = g.next)
SELECT f.word, f.form, g.root, f.n, f.n_near, f.form_n FROM f JOIN g ON g.word = f.word AND g.next IS NULL"""

_SEP = "chr(1)"


def _edit_sql(w: str, letter: str, cost: str, line: str = "''") -> str:
    """A path with one edit more: nine digits of cost, the letters, a separator, the lines."""
    return f"printf('%09d', CAST(left({w}, 9) AS INT) + {cost}) || substr({w}, 10, instr({w}, {_SEP}) - 10) || '{letter}' || substr({w}, instr({w}, {_SEP})) || {line}"


def _inserted_sql(two: str, three: str, others: list[str]) -> tuple[str, str]:
    first = f"least({two}, {', '.join(_edit_sql(w, 'I', '5', _USER) for w in (*others, three))})"
    return first, f"least({three}, {_edit_sql('(' + first + ')', 'I', '5', _ASSISTANT)})"


_USER, _ASSISTANT = "'user:' || chr(10)", "'assistant:' || chr(10)"
_OP12_EDITS = ", ".join([
    f"{_edit_sql('i0', 'D', '2')} AS w0",
    f"least({_edit_sql('i1', 'D', '2')}, CASE WHEN NOT gone AND initial = 's' THEN {_edit_sql('i0', 'K', 'm', 'line')} END) AS w1",
    f"least({_edit_sql('i2', 'D', '2')}, " + ", ".join(
        f"CASE WHEN NOT gone AND initial = 'u' THEN {_edit_sql(w, 'K', 'm', 'line')} END, CASE WHEN NOT gone THEN {_edit_sql(w, 'R', '1 + m', 'as_user')} END" for w in ("i0", "i1", "i3")) + ") AS w2",
    f"least({_edit_sql('i3', 'D', '2')}, CASE WHEN NOT gone AND initial = 'a' THEN {_edit_sql('i2', 'K', 'm', 'line')} END, CASE WHEN NOT gone THEN {_edit_sql('i2', 'R', '1 + m', 'as_assistant')} END) AS w3",
])
# A path for each role that is due, row by row; strings of cost and letters compare as the weights do.
_OP12_SQL = f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, {_crc32_sql("list_transform(string_split(key, ''), lambda x: CAST(unicode(x) AS BIGINT))")} % 20 AS h FROM t),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
q AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM o),
e AS (SELECT *, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
    role || ':' || text || chr(10) AS line, 'user:' || text || chr(10) AS as_user, 'assistant:' || text || chr(10) AS as_assistant FROM q),
e5 AS (SELECT *, CASE WHEN truncated THEN 5 ELSE 0 END AS m FROM e),
w AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, '000000000' || {_SEP} AS w0, NULL::VARCHAR AS w1, NULL::VARCHAR AS w2, NULL::VARCHAR AS w3 FROM conversations
  UNION ALL SELECT conv_id, pos, {_OP12_EDITS} FROM (
    SELECT e5.*, w0 AS i0, w1 AS i1, {_inserted_sql("w2", "w3", ["w0", "w1"])[0]} AS i2, {_inserted_sql("w2", "w3", ["w0", "w1"])[1]} AS i3
    FROM w JOIN e5 ON e5.conv_id IS NOT DISTINCT FROM w.conv_id AND e5.pos = w.pos + 1)),
z AS (SELECT conv_id, least(w0, {_inserted_sql("w2", "w3", ["w0", "w1"])[1]}) AS z FROM w QUALIFY pos = max(pos) OVER (PARTITION BY conv_id)),
a AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
    count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY conv_id)
SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(left(z, 9) AS BIGINT) AS cost, substr(z, 10, instr(z, {_SEP}) - 10) AS audit, sha256(substr(z, instr(z, {_SEP}) + 1, greatest(length(z) - instr(z, {_SEP}) - 1, 0))) AS repaired_sha256
FROM z LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM z.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat": _OP2_SQL, "op4_near_duplicates": _OP4_SQL, "op7_warc": _OP7_SQL, "op8_licenses": _op8_sql(), "op10_quality_rules": _OP10_SQL,
        "op11_spelling": _OP11_SQL, "op12_repair": _OP12_SQL,
    }
