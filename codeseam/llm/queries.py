"""The registered queries of the corpus operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, language, licences, outliers, packing, pii, prefix_trie, quality, substrings
from .common import table
from .exact_dedup import exact_duplicates
from .near_dedup import near_duplicates


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    return chat.digest_chat(chat.format_chat(turns.union(extra)))


def chat_typed_parts(spark, sf_dir):
    """The conversations with parts: the text in two pieces, and by the turn's number an image, an audio, a document, a part of
    an unknown type or a null part between them, described by columns of the row."""
    size = F.length(F.coalesce("text", F.lit("")))
    turn = F.coalesce("turn", F.lit(0))
    kind = F.element_at(F.array(*map(F.lit, ("image", "audio", "document", "video"))), (turn % 5 + 1).cast("int"))

    def part(kind, text, ref):
        values = {"type": kind, "text": text, "ref": ref, "width": size, "height": F.lit(200), "seconds": size / 8, "pages": (turn % 3).cast("int")}
        return F.struct(*(v.alias(k) for k, v in values.items())).cast(chat.PART_TYPE[6:-1])

    half = F.floor(size / 2).cast("int")
    pieces = (F.substr(F.coalesce("text", F.lit("")), F.lit(1), half), F.substr(F.coalesce("text", F.lit("")), half + 1))
    between = F.when(turn % 5 < 4, part(kind, F.lit(None).cast("string"), F.concat(F.lit("ref-"), turn.cast("string"))))
    first, last = (part(F.lit("text"), x, F.lit(None).cast("string")) for x in pieces)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.array(first, between, last).alias("parts"))
    return chat.digest_chat(chat.format_chat(turns)).drop("formatted_chars")


def op2_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80).drop("text_hash", "root")


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out(4, 2)))
    return language.identify(docs, model).select("doc_id", language.held_out(4, 2), "lang_pred", "score")


def op4_license_scan(spark, sf_dir):
    return licences.licence_report(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return decontaminate.digest_contamination(found)


def op6_pii(spark, sf_dir):
    return pii.digest_pii(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_quality(spark, sf_dir):
    labels = quality.not_held_out(table(spark, sf_dir, "labels"))
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", language.held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_substring_dedup(spark, sf_dir):
    return substrings.digest_substrings(substrings.dedup_substrings(table(spark, sf_dir, "documents"), window=50))


def op9_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_packing(spark, sf_dir):
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.digest_trie(prefix_trie.conversation_trie(table(spark, sf_dir, "conversations")))


def op12_token_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return alignment.cross_tokenizer_alignment(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_quality_rules(spark, sf_dir):
    return outliers.digest_outliers(outliers.outlier_scores(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_near_dedup, op3_language_id, op4_license_scan, op5_decontaminate, op6_pii, op7_quality, op8_substring_dedup,
        op9_exact_dedup, op10_packing, op11_prefix_trie, op12_token_alignment, op13_quality_rules, chat_typed_parts,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[\x20\x09-\x0D]+"
_TURNS = """
    SELECT conv_id, {columns}, count(*) AS n_turns,
           sha256(coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text), '')) AS turns_sha256,
           coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256
    FROM {source} GROUP BY conv_id"""


def _words(text: str, separators: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{separators}'), lambda w: w <> '')"


def _pii() -> str:
    """Spans of each kind from its matches and the texts between them; scores from words in those texts."""
    two = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": rf"\b{two}\b",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum([CASE WHEN (length(d) - i) % 2 = 0 THEN d[i]::INT WHEN d[i]::INT > 4 THEN d[i]::INT * 2 - 9 ELSE d[i]::INT * 2 END FOR i IN range(1, length(d) + 1)])"
    iban = "replace(v, ' ', '')"
    moved = f"string_split(substr({iban}, 5) || substr({iban}, 1, 4), '')"
    value = f"array_to_string([CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::VARCHAR ELSE c END FOR c IN {moved}], '')"
    valid = {
        "email": "true", "ip": "list_bool_and([length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(nullif(ltrim(p, '0'), '') AS INT), 0) <= 255 FOR p IN string_split(v, '.')])",
        "card": f"length(d) BETWEEN 12 AND 19 AND {luhn} % 10 = 0", "phone": "length(d) BETWEEN 9 AND 15",
        "iban": f"length({iban}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, [x::INT FOR x IN string_split({value}, '')]), lambda a, b: (a * 10 + b) % 97) = 1",
    }
    context = {k: v.replace(r"(?<!\w)ip(?!\w)", r"\bip\b") for k, v in pii.CONTEXT.items()}
    parts, spans = [], []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        parts.append(f"m_{kind} AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM d)")
        score = f"{round(100 * (pii.START_SCORE[kind] + (pii.CONFIRMED if kind in ('card', 'iban') else 0)))} + CASE WHEN regexp_matches(right(b, 40) || ' ' || left(a, 40), '{context[kind]}') THEN 20 ELSE 0 END"
        spans.append(
            f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s, s + length(v) AS e, least(100, {score}) AS score FROM (SELECT *, {digits} AS d FROM (SELECT doc_id, m[i] AS v, g[i] AS b, g[i + 1] AS a, "
            f"(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0))::BIGINT AS s FROM m_{kind}, unnest(range(1, len(m) + 1)) AS u(i))) WHERE {valid[kind]}"
        )
    told = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank){}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(parts)}, spans AS ({' UNION ALL '.join(spans)}) SELECT doc_id, {counts}, "
        f"sha256({told.format(" FILTER (kind <> 'iban')")}) AS base_sha256, {told.format('')} AS spans, coalesce(string_agg(score::VARCHAR, ',' ORDER BY s, rank), '') AS scores FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id"
    )


#: CRC-32 of the decimal digits of c, bit by bit: the state is divided by the reflected polynomial after each digit.
_CRC = (
    "(xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]), lambda s, x: "
    + "list_reduce([xor(s, x)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295))"
)

#: Where DuckDB can express the result over whole tables.
ORACLES = {
    "op1_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS escaped FROM t)"""
    + _TURNS.format(columns="sum(length(role) + length(escaped) + 23)::BIGINT AS formatted_chars, 0::BIGINT AS attachments, 0::BIGINT AS attachment_tokens, sha256('') AS attachments_sha256", source="e"),
    "chat_typed_parts": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, length(coalesce(text, '')) AS size, coalesce(turn, 0) AS k FROM conversations),
        a AS (SELECT *, ['image', 'audio', 'document', 'other'][k % 5 + 1] AS kind,
                     CASE k % 5 WHEN 0 THEN ceil(greatest(1, CASE WHEN size = 0 THEN 14 ELSE size END) / 14) * ceil(200 / 14) WHEN 1 THEN ceil(size / 8 * 25) WHEN 2 THEN greatest(1, k % 3) * 512 ELSE 0 END::BIGINT AS tokens,
                     row_number() OVER (PARTITION BY conv_id, k % 5 < 4 ORDER BY turn NULLS FIRST, role, text) - 1 AS n FROM t)"""
    + _TURNS.format(
        columns="count(kind) AS attachments, coalesce(sum(tokens) FILTER (kind IS NOT NULL), 0)::BIGINT AS attachment_tokens, "
        "sha256(coalesce(string_agg(n || ':' || kind || ':ref-' || k || ':' || tokens || chr(10), '' ORDER BY turn NULLS FIRST, role, text) FILTER (kind IS NOT NULL), '')) AS attachments_sha256",
        source="a",
    ),
    "op2_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_words(_LOWER.format("coalesce(text, '')"), _SPACE)} AS w FROM documents),
        s AS (SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS u(i) GROUP BY ALL),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        sets AS (SELECT min(doc_id) AS rep, list(doc_id) AS ids, any_value(n) AS n, h FROM (SELECT doc_id, md5(string_agg(x, '|' ORDER BY x)) AS h FROM s GROUP BY 1) JOIN n USING (doc_id) GROUP BY h),
        r AS (SELECT rep, x, hash(x) AS k FROM s JOIN sets ON rep = doc_id),
        c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM r a JOIN r b ON a.k = b.k AND a.x = b.x AND a.rep < b.rep GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN sets x ON x.rep = a JOIN sets y ON y.rep = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach(a, b) AS (SELECT rep, rep FROM sets UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
        top AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY 1),
        own AS (SELECT unnest(ids) AS doc_id, component FROM sets JOIN top USING (rep))
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN own USING (doc_id)""",
    "op5_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_words(_LOWER.format("coalesce(text, '')"), '[^0-9a-z' + chr(92) + 'x{80}-' + chr(92) + 'x{10FFFF}]+')} AS w FROM documents),
        b AS (SELECT item_id, {_words(_LOWER.format("coalesce(text, '')"), '[^0-9a-z' + chr(92) + 'x{80}-' + chr(92) + 'x{10FFFF}]+')} AS w FROM benchmark),
        items AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
        runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM d, (SELECT DISTINCT n FROM items), unnest(range(1, len(w) - n + 2)) AS u(i)),
        hits AS (SELECT doc_id, i, n, item_id FROM runs JOIN items USING (n, x)),
        covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY 1),
        named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op6_pii": _pii(),
    "op8_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_words("coalesce(text, '')", _SPACE)} AS w FROM documents),
        runs AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS x FROM d, unnest(range(1, len(w) - 48)) AS u(i)),
        firsts AS (SELECT x, min(doc_id) AS low FROM runs GROUP BY 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM runs JOIN firsts USING (x) WHERE low < doc_id),
        held AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
               sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(ks, i)] END, ' ')) AS kept_sha256
        FROM d LEFT JOIN held USING (doc_id)""",
    "op11_prefix_trie": """
        WITH t AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS size, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS k, g, size FROM t),
        h AS (SELECT DISTINCT c, {crc} % 9 AS h FROM o),
        r AS (SELECT h.c, k, g, size FROM h JOIN o ON o.c = h.c - h.c % 5 AND k <= h UNION ALL SELECT h.c, k, g, size FROM h JOIN o ON o.c = h.c AND k > h),
        s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, g, size FROM r),
        p AS (SELECT a.c, a.d, any_value(a.size) AS size, sha256(string_agg(b.g, '' ORDER BY b.d)) AS key FROM s a JOIN s b ON a.c = b.c AND b.d <= a.d GROUP BY ALL
              UNION ALL SELECT c, 0, 0, '' FROM h),
        f AS (SELECT c, max(d) AS len FROM p GROUP BY 1),
        n AS (SELECT key, d, min(p.c) AS c, count(*) AS n, any_value(size) AS size, sha256(coalesce(string_agg(CASE WHEN len = d THEN p.c::VARCHAR END, ',' ORDER BY p.c), '')) AS ends FROM p JOIN f ON f.c = p.c GROUP BY ALL),
        e AS (SELECT x.key, x.d, y.key AS up FROM n x LEFT JOIN p y ON y.c = x.c AND y.d = x.d - 1),
        kids AS (SELECT up, count(*) AS k FROM e WHERE up IS NOT NULL GROUP BY 1),
        a AS (SELECT y.key, sum(CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END)::BIGINT AS leaves, sum((x.n - 1) * x.size)::BIGINT AS saved FROM n x LEFT JOIN kids ON kids.up = x.key JOIN p y ON y.c = x.c AND y.d <= x.d GROUP BY 1)
        SELECT n.c AS conv_id, n.d AS depth, u.c AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, n.ends AS ends_sha256
        FROM n JOIN e USING (key) LEFT JOIN n u ON u.key = e.up LEFT JOIN kids ON kids.up = n.key JOIN a ON a.key = n.key""".replace("{crc}", _CRC),
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
             g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
        SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)""",
}
