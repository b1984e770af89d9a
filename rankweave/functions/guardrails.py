"""Safety gates over text as column expressions: normalising, redaction, injection signals, context gates, generated text.

Each rule exists once, as a pattern that Java's engine and RE2 read alike; ``sql_*`` gives the DuckDB form of the same rule.
Patterns are tried only where a plain substring search of a squeezed view says that they can match. Texts are expected in NFC.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.text import ACCENTED, FOLDED, unaccented

# Invisible and control characters that are removed, and what counts as outer space.
REMOVED = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
SPACES = " \n\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Personal data.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?:\+?84|0)(?:3|5|7|8|9)\d(?:[\s.-]?\d){7,8}"
URL = r"(?i)\b(?:https?://|www\.)\S+|\b(?:linkedin|github|facebook|twitter|x)\.com/\S+"
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"
LABELLED = (
    r"(?im)^\s*(?:full[ _-]?name|name|họ\s*(?:và\s*)?tên|ứng\s*viên|candidate|cccd|cmnd|passport|resume[ _-]?id|application[ _-]?id|user[ _-]?id|storage[ _-]?path)\s*[:=].*$"
)
# Secrets.
SECRETS = {
    "assignment": r"(?i)\b(?:api[_-]?key|secret|password|token)\s*[:=]\s*[^\s,;]+",
    "bearer": r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}",
    "sk": r"\bsk-[A-Za-z0-9_-]{12,}\b",
    "aiza": r"\bAIza[0-9A-Za-z_-]{20,}\b",
    "gh": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b",
}
SECRET_ANCHORS = {"assignment": ["key", "secret", "password", "token"], "bearer": ["bearer"], "sk": ["sk-"], "aiza": ["aiza"], "gh": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], "jwt": ["eyj"]}
# Signals of an injection in the lower-cased text.
INJECTIONS = {
    "ignore_instructions": r"\b(?:ignore|disregard|forget|bỏ qua)\b.{0,40}\b(?:instruction|prompt|chỉ dẫn|yêu cầu)",
    "reveal_prompt": r"\b(?:show|reveal|print|tiết lộ|hiển thị)\b.{0,40}\b(?:system prompt|developer message|prompt hệ thống)",
    "role_override": r"\b(?:you are now|từ giờ bạn là)\b",
    "external_action": r"\b(?:send|upload|exfiltrate|gửi|tải)\b.{0,50}\b(?:elsewhere|server|url|email|ra ngoài|máy chủ)\b",
    "tool_override": r"\b(?:call|invoke|run|execute|gọi|chạy)\b.{0,30}\b(?:tool|command|shell|sql|công cụ|lệnh)\b",
}
# Signals in the folded text.
FOLDED_INJECTIONS = {
    "ignore_instructions": r"\b(?:bo qua|quen)\b.{0,40}\b(?:instruction|prompt|chi dan|yeu cau)\b",
    "reveal_prompt": r"\b(?:tiet lo|hien thi|in|cho biet)\b.{0,40}\b(?:system prompt|prompt he thong)\b",
    "role_override": r"\btu gio ban la\b",
    "tool_override": r"\b(?:goi|chay)\b.{0,30}\b(?:tool|command|shell|sql|cong cu|lenh)\b",
    "destructive_action": r"\b(?:drop\s+(?:table|database)|truncate\s+table|delete\s+from|alter\s+table)\b|\brm\s+-[a-z]*r[a-z]*f\b",
    "encoded_instruction": (
        r"\b(?:decode|base64|hex(?:adecimal)?)[-\s\w]{0,50}\b(?:follow|execute|run|instruction|command)\b|\b(?:follow|execute|run)[-\s\w]{0,50}\b(?:base64|hex(?:adecimal)?)[-\s]*(?:instruction|command)\b"
    ),
}
DEFERRED = r"\b(?:remember|store|save|memorize|ghi nho|luu lai)\b.{0,80}\b(?:instruction|prompt|command|chi dan|yeu cau|lenh)\b.{0,80}\b(?:later|next|after|sau|lat nua|tiep theo)\b"
# Requests for protected information, in the folded text.
PROTECTED_REQUESTS = [
    r"\b(?:show|give|send|tell|print|display|reveal|expose|dump|repeat|quote|translate|summari[sz]e|share|provide|can i see|may i see)\b.{0,60}"
    r"\b(?:system prompt|developer (?:message|instruction)|prompt template|internal prompt|system (?:instruction|message|policy)|tool (?:schema|configuration|config)|your prompt|agent prompt)\b",
    r"\b(?:what is|what are|describe|explain)\b.{0,30}\b(?:your|the internal|the configured|current)\b.{0,20}\b(?:system prompt|developer (?:message|instruction)|prompt|tool (?:schema|config))\b",
    r"\b(?:show|give|send|tell|print|display|reveal|expose|dump|share|provide)\b.{0,40}\b(?:your|the|internal|configured|actual|real|current)\b.{0,12}\b(?:api key|secret|password|token)\b",
    r"\b(?:give|send|provide|share)\b.{0,15}\b(?:me|us|to me|to us)\b.{0,15}\b(?:an?\s+|the\s+|your\s+)?(?:api key|secret|password|token)\b",
    r"\b(?:what is|what are|where is|where are)\b.{0,30}\b(?:your|the internal|the configured|current)\b.{0,12}\b(?:api key|secret|password|token)\b",
    r"\b(?:cho|dua|gui|noi|in|hien thi|tiet lo|lap lai|trich dan|dich|tom tat|chia se|cung cap|cho biet)\b.{0,60}"
    r"\b(?:system prompt|developer message|developer instruction|prompt template|internal prompt|prompt he thong|prompt cua ban|chi dan he thong|thong diep developer|cau hinh cong cu|api key|secret|mat khau|token)\b",
    r"\b(?:mo ta|giai thich|cho biet)\b.{0,40}\b(?:system prompt|prompt he thong|chi dan he thong)\b.{0,20}\b(?:cua ban|noi bo)\b",
    r"\b(?:api key|secret|mat khau|token)\b.{0,20}\b(?:cua ban|he thong|noi bo)\b.{0,15}\b(?:la gi|o dau|cho toi|gui toi)\b",
]
PROTECTED_ASSET = (
    r"\b(?:(?:database|db)[\s._-]+(?:schema|structure)|(?:schema|structure)[\s._-]+(?:database|db)|data model|erd|entity relationship diagram|sql\s+ddl(?:\s+migrations?)?|rls\s+polic(?:y|ies)|database[_\s-]*url|"
    r"connection string|environment variables?|env variables?|\.env|source tree|file paths?|project (?:url|reference|ref)|(?:[a-z0-9]+[_-])*service[\s_-]*role[\s_-]*key|"
    r"(?:[a-z0-9]+[_-])*(?:api[_-]?key|anon[_-]?key|secret|password|token)|server\s+hostname|hostname\s+and\s+port|private openapi routes?|hidden internal instructions?|internal rules|"
    r"(?:tables?|columns?|foreign keys?|indexes?|rpc|storage buckets?|bang|cot|khoa ngoai)|(?:store|luu)\s+(?:candidate|ung vien)\s+(?:records?|data|du lieu)|"
    r"cau truc\s+co\s+so\s+du\s+lieu|kien truc\s+du\s+lieu|bien\s+moi\s+truong|cay\s+ma\s+nguon|duong\s+dan\s+tep)\b"
)
PROTECTED_CONTEXT = r"\b(?:your|internal|private|production|actual|real|configured|current|system|agent|backend|supabase|used by|you use|internally|cua ban|cua he thong|noi bo|thuc te|that|dang dung)\b"
PROTECTED_ACTION = (
    r"\b(?:show|give|send|tell|print|display|reveal|expose|dump|list|export|translate|put|provide|share|summarize|what|how do you|"
    r"cho|dua|gui|noi|in|hien thi|tiet lo|liet ke|dich|cung cap|cho xem|cho toi)\b"
)
INHERENT_SECRET = r"\b(?:database[_\s-]*url|connection string|(?:[a-z0-9]+[_-])*service[\s_-]*role[\s_-]*key|(?:[a-z0-9]+[_-])*(?:api[_-]?key|anon[_-]?key|secret|password|token))\b|(?:^|\s)\.env\b"
# Spelled-out words and frequent misspellings, with what they are read as, and the letters without which none occurs.
RESPELLED = [
    (r"\bs[\s._-]{0,3}h[\s._-]{0,3}[o0][\s._-]{0,3}w\b", "show", "show"),
    (r"\bd[\s._-]{0,3}[a4][\s._-]{0,3}t[\s._-]{0,3}a[\s._-]{0,3}b[\s._-]{0,3}a[\s._-]{0,3}s[\s._-]{0,3}e\b", "database", "database"),
    (r"\bs[\s._-]{0,3}c[\s._-]{0,3}h[\s._-]{0,3}[e3][\s._-]{0,3}m[\s._-]{0,3}a\b", "schema", "schema"),
    (r"\bs[\s._-]{0,3}y[\s._-]{0,3}s[\s._-]{0,3}t[\s._-]{0,3}[e3][\s._-]{0,3}m\b", "system", "system"),
    (r"\bp[\s._-]{0,3}r[\s._-]{0,3}[o0][\s._-]{0,3}m[\s._-]{0,3}p[\s._-]{0,3}t\b", "prompt", "prompt"),
    (r"\bprom+t\b", "prompt", "prom"), (r"\bpr0mpt\b", "prompt", "prompt"), (r"\bsytem\b", "system", "sytem"), (r"\bsyst3m\b", "system", "system"),
    (r"\bk3y\b", "key", "key"), (r"\bapi[_-]?k[e3]y\b", "api key", "apikey"), (r"\binstrution\b", "instruction", "instrution"),
    (r"\binstructon\b", "instruction", "instructon"), (r"\bd4tabase\b", "database", "database"), (r"\bsch3ma\b", "schema", "schema"),
    (r"\bsh0w\b", "show", "show"), (r"\binternally\b", "internal", "internally"),
]
#: Squeezed substrings of which one is in every text that has a signal; the last two groups need one of each part.
ANCHORS = (
    "instru prom chidan yeucau youarenow tugiobanla droptable dropdatabase truncatetable deletefrom altertable developermessage developerinstruction "
    "systeminstruction systemmessage systempolicy toolschema toolconfig apikey secret password token matkhau cauhinhcongcu"
).split()
EXTERNAL = (["send", "upload", "exfiltrate", "gui", "tai"], ["elsewhere", "server", "url", "email", "rangoai", "maychu"])
TOOLS = (["call", "invoke", "run", "execute", "goi", "chay"], ["tool", "command", "shell", "sql", "congcu", "lenh"])
CODED = (["decode", "base6a", "hex"], ["follow", "execute", "run", "instruction", "command"])
LATER = (["remember", "store", "save", "memorize", "ghinho", "luulai"], ["command", "lenh"])
ASSETS = (
    "database schema structure datamodel entityrel ddl rls connectionstring environmentvar envvar sourcetree filepath projecturl projectref servicerolekey apikey anonkey secret password "
    "token hostname privateopenapi hiddeninternal internalrules table column foreignkey index rpc storagebucket bang khoangoai storecandidate luucandidate luuungvien cautruc kientruc "
    "bienmoitruong caymanguon duongdantep"
).split()
#: Words of an asset that squeezing makes of the ends and beginnings of others in most texts: they are looked for as words.
SHORT_ASSETS = ["erd", "cot", "env"]
INHERENT = "databaseurl connectionstring servicerolekey apikey anonkey secret password token".split()
CONTEXTS = "your internal private production actual real configured current system agent backend supabase usedby youuse cuaban cuahethong noibo thucte that dangdung".split()

# What generated text must not disclose.
DISCLOSURE = (
    r"(?i)\b(?:system prompt|developer (?:message|instruction)|prompt template|internal prompt|your prompt|agent prompt|system (?:instruction|message|policy)|tool (?:schema|configuration)|prompt hệ thống|"
    r"prompt của bạn|chỉ dẫn hệ thống|thông điệp developer|cấu hình công cụ|prompt he thong|prompt cua ban|chi dan he thong|thong diep developer|cau hinh cong cu)\b"
)
ARCHITECTURE = (
    r"(?i)(?:\b(?:database|db)\s+schema\s*:\s*[a-z_][\w.]*\s*\([^)]*\)|\binternal\s+tables?\s*:\s*[a-z_][\w.,\s-]*|\bdatabase[_\s-]*url\s*[:=]\s*\S+|\b(?:supabase\s+)?service[\s_-]*role[\s_-]*key\b|"
    r"\b(?:internal|private|production)\s+(?:database|db)\s+(?:schema|structure)\b)"
)
STACK_TRACE = r"(?i)(?:traceback \(most recent call last\)|(?:file|module) [\"'][^\"']+\.py[\"'].*line \d+|(?:exception|error):\s+.*(?:backend/app|backend\\app))"


_MARKS = "".join(map(chr, range(0x300, 0x370)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def _trimmed(text: Column) -> Column:
    """text without outer space; one whose ends are no space is not taken apart."""
    ends = reduce(lambda a, b: a | b, (F.startswith(text, F.lit(c)) | F.endswith(text, F.lit(c)) for c in SPACES))
    return F.when(ends, F.btrim(text, F.lit(SPACES))).otherwise(text)


def normalized(text: Column) -> Column:
    """Line ends made \\n, invisible and control characters and outer space gone; null stays null."""
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return let(F.when(text.rlike(REMOVED.replace("[", "[\\r", 1)), F.regexp_replace(lines, REMOVED, "")).otherwise(text), _trimmed)


def squeezed(low: Column) -> Column:
    """A lower-cased text without accents, blanks and dashes, signs read as the letters they stand for: for substring searches only."""
    return F.translate(low, f"{ACCENTED}043 \t\n\x0b\f\r._-{_MARKS}", f"{FOLDED}oae")


def folded(plain: Column, squeeze: Column) -> Column:
    """The view in which signals are looked for: an unaccented text, spelled-out and misspelled words restored, blanks squeezed."""
    steps = F.filter(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(w).alias("w"), F.lit(a).alias("a")) for p, w, a in RESPELLED)), lambda s: F.contains(squeeze, s["a"]))
    done = F.aggregate(steps, plain, lambda t, s: F.regexp_replace(t, s["p"], s["w"]))
    return F.trim(F.regexp_replace(done, r"\s+", " "))


def _inherent(view: Column, squeeze: Column) -> Column:
    """Whether a view, or the unaccented text that it is made from, may name a secret."""
    return has_any(squeeze, INHERENT) | (F.contains(squeeze, F.lit("env")) & F.contains(view, F.lit(".env")))


def _assets(view: Column, squeeze: Column) -> Column:
    """Whether a view, or the unaccented text that it is made from, may name an asset."""
    return has_any(squeeze, ASSETS) | (has_any(squeeze, SHORT_ASSETS) & view.rlike(r"\b(?:erd|cot)\b|\.env"))


def _protected(view: Column, squeeze: Column) -> Column:
    asks = has_any(squeeze, ANCHORS) & reduce(lambda a, b: a | b, (view.rlike(p) for p in PROTECTED_REQUESTS))
    inherent = _inherent(view, squeeze) & view.rlike(INHERENT_SECRET)
    return asks | (_assets(view, squeeze) & view.rlike(PROTECTED_ACTION) & (inherent | (has_any(squeeze, CONTEXTS) & view.rlike(PROTECTED_CONTEXT) & view.rlike(PROTECTED_ASSET))))


def injection_signals(text: Column) -> Column:
    """Names of the signals in a normalised text, in a fixed order, each once; none for null."""
    both = lambda s, pair: has_any(s, pair[1]) & has_any(s, pair[0])
    needed = {"external_action": lambda s: both(s, EXTERNAL), "tool_override": lambda s: both(s, TOOLS), "encoded_instruction": lambda s: both(s, CODED)}
    test = lambda k, s: needed.get(k, lambda s: has_any(s, ANCHORS) | F.contains(s, F.lit("rm")))(s)

    def named(low: Column, view: Column, s: Column) -> Column:
        raw = [F.when(test(k, s) & low.rlike(p), F.lit(k)) for k, p in INJECTIONS.items()]
        more = [F.when(test(k, s) & view.rlike(p), F.lit(k)) for k, p in FOLDED_INJECTIONS.items()]
        later = (has_any(s, ANCHORS) | both(s, LATER)) & view.rlike(DEFERRED)
        return F.array_distinct(F.array_compact(F.array(*raw, *more, F.when(_protected(view, s), F.lit("protected_information_request")), F.when(later, F.lit("deferred_instruction")))))

    def looked(low: Column, s: Column) -> Column:
        plain = unaccented(low)
        pairs = reduce(lambda a, b: a | b, (both(s, x) for x in (EXTERNAL, TOOLS, CODED, LATER)))
        maybe = has_any(s, ANCHORS) | _inherent(plain, s) | pairs | (F.contains(s, F.lit("rm")) & low.rlike(r"rm\s+-")) | (has_any(s, CONTEXTS) & _assets(plain, s))
        return F.when(maybe, let(folded(plain, s), lambda view: named(low, view, s))).otherwise(F.array().cast("array<string>"))

    return F.coalesce(let(F.lower(text), lambda low: let(squeezed(low), lambda s: looked(low, s))), F.array().cast("array<string>"))


def secrets(text: Column) -> Column:
    """Names of the kinds of secret in a text."""
    found = lambda t: let(F.lower(t), lambda low: F.array_compact(F.array(*(F.when(has_any(low, SECRET_ANCHORS[k]) & t.rlike(p), F.lit(k)) for k, p in SECRETS.items()))))
    return F.coalesce(let(text, found), F.array().cast("array<string>"))


def sanitized(text: Column) -> Column:
    """(value, changed): a normalised text without labelled identity lines, its addresses, phone numbers, links and ids replaced by marks."""
    step = lambda test, pattern, mark: lambda t: F.when(test(t), F.regexp_replace(t, pattern, mark)).otherwise(t)
    marks = lambda t: has_any(F.lower(t), ["http://", "https://", "www.", ".com/"])
    steps = [
        step(lambda t: has_any(t, [":", "="]), LABELLED.replace("(?im)", "(?imu)"), ""), step(lambda t: F.contains(t, F.lit("@")), EMAIL, "[REDACTED_EMAIL]"),
        step(lambda t: has_any(t, ["84", "03", "05", "07", "08", "09"]), rf"(?<!\w){PHONE}(?!\w)", "[REDACTED_PHONE]"), step(marks, URL, "[REDACTED_URL]"),
        step(lambda t: F.contains(t, F.lit("-")), UUID, "[REDACTED_ID]"), step(lambda t: F.contains(t, F.lit("\n\n\n")), r"\n{3,}", "\n\n"),
    ]
    done = reduce(lambda value, s: let(value, s), steps, text)
    return let(let(done, _trimmed), lambda v: F.struct(v.alias("value"), (v != text).alias("changed")))


def without_signals(text: Column) -> Column:
    """The text less its lines with a signal."""
    kept = F.filter(F.split(text, "\n"), lambda line: F.size(injection_signals(F.btrim(line, F.lit(SPACES)))) == 0)
    return F.btrim(F.array_join(kept, "\n"), F.lit(SPACES))


_GATED = "struct<action:string,value:string,codes:array<string>,signals:array<string>>"


def gate(text: Column, source: str = "cv", budget: int = 20_000, redact_pii: bool = True) -> Column:
    """(action, value, codes, signals) of a context gate: pass, sanitize, degrade or block.

    The text is cut to the budget before it is looked at. Null counts as empty: degrade.
    """
    codes = lambda *c: F.array_compact(F.array(*c))
    answer = lambda action, value, c, signals: F.struct(action.alias("action"), value.alias("value"), c.alias("codes"), signals.alias("signals"))
    none = F.array().cast("array<string>")

    def decided(cut: Column, over: Column, signals: Column, clean: Column) -> Column:
        some = F.size(signals) > 0
        rest = F.when(some, without_signals(clean["value"])).otherwise(clean["value"])

        def named(value: Column) -> Column:
            action = (
                F.when(value == "", "degrade").when(some, "sanitize").when(over, "degrade").when(clean["changed"], "sanitize").otherwise("pass")
            )
            found = codes(
                F.when(over, F.lit("DATA_BUDGET_EXCEEDED")), F.when(clean["changed"], F.lit("DATA_PII_REDACTED")), F.when(some, F.lit("DATA_INJECTION_SIGNAL")),
                F.when(value == "", F.lit("DATA_LOW_CONTENT")),
            )
            return answer(action, value, found, signals)

        return let(rest, named)

    def signalled(cut: Column, over: Column) -> Column:
        clean = sanitized(cut) if redact_pii else F.struct(cut.alias("value"), F.lit(False).alias("changed"))

        def by_source(signals: Column) -> Column:
            open_ = let(clean, lambda c: decided(cut, over, signals, c))
            if source != "chat":
                return open_
            asked = F.array_contains(signals, "protected_information_request") & (F.size(F.array_except(signals, F.array(F.lit("reveal_prompt"), F.lit("protected_information_request")))) == 0)
            code = F.when(asked, "DATA_PROTECTED_INFO_REQUEST").otherwise("DATA_INJECTION_SIGNAL")
            return F.when(F.size(signals) > 0, answer(F.lit("block"), F.lit(""), F.array(code), signals)).otherwise(open_)

        return let(injection_signals(cut), by_source)

    def opened(t: Column) -> Column:
        over = F.length(t) > budget
        cut = F.when(over, F.rtrim(F.substring(t, 1, budget))).otherwise(t)
        return (
            F.when(t == "", answer(F.lit("degrade"), F.lit(""), F.array(F.lit("DATA_LOW_CONTENT")), none))
            .otherwise(let(cut, lambda c: F.when(F.size(secrets(c)) > 0, answer(F.lit("block"), F.lit(""), F.array(F.lit("DATA_SECRET_DETECTED")), none)).otherwise(signalled(c, over))))
        )

    return let(normalized(F.coalesce(text, F.lit(""))), opened).cast(_GATED)


def gate_fields(fields: list[Column], budget: int = 4000) -> Column:
    """(action, values, codes) of one record's several fields: the first block decides, then the last that is not a pass."""
    gated = F.array(*(gate(F.coalesce(f, F.lit("")), "retrieval", budget) for f in fields))

    def joined(g: Column) -> Column:
        real = F.filter(F.zip_with(g, F.array(*(F.coalesce(f, F.lit("")) != "" for f in fields)), lambda x, there: F.struct(x.alias("g"), there.alias("there"))), lambda p: p["there"])
        blocked = F.filter(real, lambda p: p["g"]["action"] == "block")
        softened = F.filter(real, lambda p: p["g"]["action"] != "pass")
        action = F.when(F.size(blocked) > 0, "block").otherwise(F.coalesce(F.get(softened, F.size(softened) - 1)["g"]["action"], F.lit("pass")))
        values = F.when(F.size(blocked) > 0, F.array().cast("array<string>")).otherwise(F.transform(g, lambda x: x["value"]))
        codes = F.when(F.size(blocked) > 0, F.get(blocked, F.lit(0))["g"]["codes"]).otherwise(F.array_distinct(F.flatten(F.transform(real, lambda p: p["g"]["codes"]))))
        return F.struct(action.alias("action"), values.alias("values"), codes.alias("codes"))

    return let(gated, joined)


def discloses(text: Column) -> Column:
    return text.rlike(DISCLOSURE.replace("(?i)", "(?iu)")) | text.rlike(ARCHITECTURE)


def checked_output(text: Column, evidence: Column, budget: int, fallback: str, configured: list[str] | None = None) -> Column:
    """(value, action, code) of a generated text: allow, sanitize or fallback; code is null where it is allowed.

    configured: credentials of the running system, of which no text may hold one of twelve characters or more.
    """
    answer = lambda value, action, code: F.struct(value.alias("value"), F.lit(action).alias("action"), (F.lit(code) if code else F.lit(None).cast("string")).alias("code"))
    fallen = lambda code: answer(F.lit(fallback), "fallback", code)

    def looked(v: Column) -> Column:
        own = [c for c in configured or [] if len(c) >= 12]
        usable = F.filter(F.transform(F.coalesce(evidence, F.array().cast("array<string>")), lambda e: F.lower(F.btrim(e, F.lit(SPACES)))), lambda e: e.isNotNull() & (e != ""))
        grounded = lambda value: (F.size(usable) == 0) | F.exists(usable, lambda e: (F.length(e) >= 2) & F.contains(F.lower(value), e))

        def cleaned(c: Column) -> Column:
            value = F.when(c["changed"], c["value"]).otherwise(v)
            return (
                F.when(c["changed"] & (c["value"] == ""), fallen("OUTPUT_PII_DETECTED")).when(~grounded(value), fallen("OUTPUT_UNGROUNDED"))
                .when(c["changed"], answer(value, "sanitize", "OUTPUT_PII_DETECTED")).otherwise(answer(value, "allow", None))
            )

        return (
            F.when(has_any(v, own) if own else F.lit(False), fallen("OUTPUT_SECRET_DETECTED")).when(v.rlike(STACK_TRACE), fallen("OUTPUT_INTERNAL_ERROR_LEAK"))
            .when(discloses(v), fallen("OUTPUT_PROMPT_LEAKAGE")).when(F.size(secrets(v)) > 0, fallen("OUTPUT_PII_DETECTED"))
            .when((v == "") | (F.length(v) > budget), fallen("OUTPUT_INVALID_SCHEMA")).otherwise(let(sanitized(normalized(v)), cleaned))
        )

    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), looked)


# --- the same rules as DuckDB SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_normalized(text: str) -> str:
    lines = f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return f"trim(regexp_replace({lines}, {q(REMOVED)}, '', 'g'), {q(SPACES)})"


def sql_folded(text: str) -> str:
    out = f"regexp_replace(translate(lower({text}), {q(ACCENTED)}, {q(FOLDED)}), '[\\x{{300}}-\\x{{36F}}]', '', 'g')"
    for pattern, word, _ in RESPELLED:
        out = f"regexp_replace({out}, {q(pattern)}, '{word}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'), ' ')"


def sql_signals(low: str, view: str) -> str:
    m = lambda t, p: f"regexp_matches({t}, {q(p)})"
    protected = " OR ".join(m(view, p) for p in PROTECTED_REQUESTS)
    protected += f" OR ({m(view, PROTECTED_ACTION)} AND ({m(view, INHERENT_SECRET)} OR ({m(view, PROTECTED_CONTEXT)} AND {m(view, PROTECTED_ASSET)})))"
    raw = {k: m(low, p) for k, p in INJECTIONS.items()}
    more = {k: m(view, p) for k, p in FOLDED_INJECTIONS.items()}
    every = {k: " OR ".join(x[k] for x in (raw, more) if k in x) for k in [*raw, *(k for k in more if k not in raw)]} | {"protected_information_request": protected, "deferred_instruction": m(view, DEFERRED)}
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in every.items()) + "], lambda x: x IS NOT NULL)"


def sql_secrets(text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, {q(p)}) THEN '{k}' END" for k, p in SECRETS.items()) + "], lambda x: x IS NOT NULL)"


def sql_sanitized(text: str) -> str:
    """RE2 has no look-around, so the phone pattern takes its neighbours along and is applied twice for numbers next to each other."""
    phone = q(rf"(^|[^\w])({PHONE})($|[^\w])")
    out = f"regexp_replace({text}, {q(LABELLED)}, '', 'g')"
    out = f"regexp_replace({out}, {q(EMAIL)}, '[REDACTED_EMAIL]', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, {phone}, '\\1[REDACTED_PHONE]\\3', 'g')"
    out = f"regexp_replace(regexp_replace({out}, {q(URL)}, '[REDACTED_URL]', 'g'), {q(UUID)}, '[REDACTED_ID]', 'g')"
    return f"trim(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {q(SPACES)})"
