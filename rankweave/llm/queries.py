"""The thin queries opN_<name> over the whole test tables, and the SQL that some of them equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import bpe, chat, decontaminate, html, langid, licenses, lm, near, packing, toxicity, variants, vectors, whiten
from rankweave.llm.common import held_out, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.group(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = toxicity.fit(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, fitted, carry=["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 4).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, TOKENIZER, carry=["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    names = F.array_join(F.transform("licenses", lambda x: x["name"]), ",")
    best = F.coalesce(F.array_max(F.transform("licenses", lambda x: x["share"])), F.lit(0.0))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), names.alias("licenses"), best.alias("best_share"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    samples = langid.learn(docs.where(~held_out("doc_id", 4)))
    found = langid.identify(docs, samples, carry=["doc_id"])
    return found.select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    back = chat.unpack(*chat.pack(rows.union(probe)))
    spoken = F.array_join("learned", "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(spoken).cast("long").alias("loss_chars"),
        F.sha2(spoken, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.group(table(spark, sf_dir, "embeddings"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, ~held_out("doc_id", 7), RANKS, public_tokenizers.PATTERN, carry=["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER, keep_ids=False)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = whiten.whiten(table(spark, sf_dir, "embeddings"), components=32)
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "own"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("own.whitened").alias("whitened"), F.col("own.explained").alias("explained"), "identity_error")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = variants.runs(table(spark, sf_dir, "documents").select("doc_id", "text"), least=7)  # a shorter run gives no word
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    place = (h % F.length("word")).cast("int")
    rest = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.length("word")))
    words = runs.select(F.when(h % 31 == 0, rest).otherwise(F.col("word")).alias("word"))
    return variants.group(variants.vocabulary(words, 7, 2)).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_near_dedup": op2_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_license_scan": op5_license_scan,
    "op6_html_text": op6_html_text,
    "op7_language_id": op7_language_id,
    "op9_lm_score": op9_lm_score,
    "op10_chat_format": op10_chat_format,
    "op8_vector_dedup": op8_vector_dedup,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_whitening": op12_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '{}')"
_ESCAPED = "{}"
for _old, _new in chat.ESCAPES:
    _ESCAPED = f"replace({_ESCAPED}, {'chr(10)' if _old == chr(10) else repr(_old).replace(chr(92) * 2, chr(92))}, '{_new}')"

#: Nodes (a, b) of links and all ids to (id, least id reachable), for the SQL below.
_REACH = """reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT reach.id, b FROM reach JOIN links ON links.a = reach.other),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

#: DuckDB SQL over the same tables, for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_decontamination": f"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM win))),
found AS (SELECT doc_id, n, i, item_id FROM grams JOIN win USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op2_near_dedup": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS.format("[^\\x20\\x09-\\x0D]+")} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN component ON id = doc_id LEFT JOIN n USING (doc_id)""",
    "op8_vector_dedup": f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN component ON id = vec_id""",
    "op10_chat_format": f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.OPEN) + len(chat.MIDDLE) + len(chat.CLOSE)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars FROM said GROUP BY conv_id""",
    "op13_spelling_variants": """WITH RECURSIVE crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS k FROM run GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END)) AS b FROM counted),
hashed AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
cut AS (SELECT k, CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM hashed),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
less AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word)))::INT AS i FROM v)),
pair AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word UNION SELECT word, d FROM less WHERE d IN (SELECT word FROM v) UNION SELECT d, word FROM less WHERE d IN (SELECT word FROM v)),
best AS (SELECT a, count(*) AS n_near, arg_max({'b': b, 'n': n}, {'n': n, 'less': -rank}) AS best FROM pair JOIN (SELECT word, n, row_number() OVER (ORDER BY word) AS rank FROM v) ON b = word GROUP BY a),
known AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * v.n THEN best.b END AS form, CASE WHEN best.n >= 10 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best ON a = word),
path(word, place, steps) AS (SELECT word, word, 0 FROM known UNION ALL SELECT path.word, form, steps + 1 FROM path JOIN known ON known.word = place WHERE form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM known JOIN (SELECT word, arg_max(place, steps) AS root FROM path GROUP BY word) USING (word)""",
}
