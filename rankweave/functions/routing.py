"""What a chat message asks for: language, topic, entities and the first rule that fits, as column expressions over one folded view."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.guardrails import let
from rankweave.functions.unicode import trimmed, words

# Names of places, fields and companies, in the order in which the first one named counts.
LOCATIONS = [
    "hà nội", "hanoi", "tp hcm", "tphcm", "hồ chí minh", "ho chi minh", "đà nẵng", "da nang", "hải phòng", "hai phong", "cần thơ", "can tho", "bình dương", "binh duong", "đồng nai", "dong nai",
    "remote", "online", "từ xa", "tại nhà", "vn", "việt nam", "vietnam",
]
DOMAINS = [
    "ai", "machine learning", "ml", "deep learning", "data scientist", "data engineer", "data analyst", "data", "ai engineer",
    "logistic", "logistics", "vận tải", "kho vận", "supply chain", "chuỗi cung ứng", "marketing", "digital marketing", "seo", "content", "truyền thông",
    "kế toán", "kiểm toán", "accounting", "finance", "tài chính", "ngân hàng", "banking", "bán hàng", "sales", "kinh doanh", "business development",
    "nhân sự", "hr", "recruitment", "tuyển dụng", "it", "lập trình", "developer", "software", "backend", "frontend", "fullstack",
    "mobile", "ios", "android", "devops", "cloud", "product manager", "product owner", "business analyst", "ba", "qc", "qa", "tester", "ui/ux", "designer", "thiết kế",
    "security", "an toàn thông tin", "ecommerce", "thương mại điện tử", "python", "java", "javascript", "react", "node", "golang",
]
COMPANIES = ["vng", "fpt", "viettel", "tiki", "shopee", "momo", "techcombank", "grab", "be group", "zalo", "cmc", "nashtech", "kms", "axon active", "logivan", "base.vn", "sky mavis", "coccoc"]
# What messages of each kind say.
SAYS = {
    "lists": [
        "các công việc hiện có", "công việc hiện có", "danh sách việc làm", "danh sách công việc", "tất cả công việc", "tất cả việc làm", "những việc đang tuyển", "những việc làm đang tuyển",
        "có những việc nào", "có việc gì", "hiện có những việc nào", "việc làm hiện có", "xem danh sách việc", "xem việc làm", "các việc làm hiện có", "các vị trí đang tuyển",
        "vị trí đang tuyển", "danh sách tuyển dụng", "các tin tuyển dụng", "tin tuyển dụng hiện có", "show all jobs", "all jobs", "list jobs", "show jobs", "available jobs",
        "available positions", "open positions", "current openings", "job vacancies", "give me list of job", "give me a list of jobs", "give me the list of jobs",
        "show me jobs", "what jobs are available", "any jobs available",
    ],
    "browses": [
        "tìm việc", "tìm công việc", "tìm việc làm", "tìm job", "công việc", "việc làm", "vị trí", "find jobs", "find a job", "search jobs", "search for jobs", "looking for work",
        "jobs about", "jobs for", "job opening", "job openings", "openings", "positions",
    ],
    "uses_cv": [
        "phù hợp với cv", "phù hợp với tôi", "phù hợp với mình", "match với cv", "match với tôi", "match cv với", "match resume with", "suitable for my cv", "suitable for me", "match my cv", "fit my profile",
        "based on my cv", "based on my resume", "using my cv", "using my resume", "jobs for my cv", "jobs for my resume", "dựa trên cv", "dựa trên hồ sơ", "theo cv của tôi",
        "theo hồ sơ của tôi", "từ cv của tôi", "cv của tôi", "hồ sơ của tôi",
    ],
    "evaluates": [
        "đánh giá cv", "đánh giá resume", "đánh giá hồ sơ", "chấm điểm cv", "review cv", "review my cv", "review my resume", "rate my cv", "rate my resume", "evaluate my cv", "evaluate my resume",
        "cv mạnh yếu", "cv tôi mạnh yếu", "cv tốt không", "cv có tốt không", "điểm mạnh điểm yếu", "strengths and weaknesses", "resume feedback", "cv feedback",
        "cv của tôi như thế nào", "hồ sơ của tôi thế nào", "hồ sơ của tôi như thế nào", "feedback on my resume", "feedback on my cv",
    ],
    "lacks": [
        "bổ sung", "cần học", "kỹ năng gì", "thiếu kỹ năng", "học thêm", "lộ trình", "skill gap", "yêu cầu thêm", "học gì", "cần cải thiện", "cần phát triển",
        "what should i learn", "what do i need to learn", "skills do i need", "missing skills", "skills am i missing", "learning path", "career roadmap",
        "improve my skills", "skills to improve", "skills should i improve",
    ],
    "screens": [
        "gợi ý ứng viên", "tìm ứng viên", "ứng viên phù hợp", "lọc ứng viên", "đánh giá ứng viên", "xếp hạng ứng viên", "candidate matching",
        "find candidates", "screen candidates", "rank candidates", "recommend candidates", "suitable candidates", "candidate shortlist", "shortlist candidates",
    ],
    "wants_jobs": [
        "gợi ý việc", "gợi ý công việc", "gợi ý job", "việc phù hợp", "công việc phù hợp", "tôi cần việc", "tìm việc", "tìm công việc", "tìm việc làm", "recommend jobs", "recommend a job", "job recommendation",
        "job search", "find me a job", "help me find a job", "suggest jobs",
    ],
    "recruits": [
        "cv", "resume", "hồ sơ", "việc", "công việc", "job", "jobs", "career", "nghề nghiệp", "tuyển dụng", "ứng viên", "candidate", "candidates", "nhà tuyển dụng", "recruiter",
        "phỏng vấn", "interview", "kỹ năng", "skill", "skills", "kinh nghiệm", "experience", "mức lương", "salary", "job description", "jd", "vacancy", "opening", "position",
    ],
    "chats": ["xin chào", "chào bạn", "cảm ơn", "bạn là ai", "hướng dẫn", "giúp đỡ", "hello", "hi", "hey", "thanks", "thank you", "who are you", "help me"],
    "chat_with_work": ["cv", "resume", "job", "việc", "tuyển", "ứng", "hồ sơ", "kỹ năng", "skill", "cải thiện", "đánh giá", "lộ trình", "học", "match"],
    "topic_with_work": ["cv", "resume", "job", "việc", "tuyển", "ứng", "hồ sơ", "kỹ năng", "skill", "experience", "kinh nghiệm"],
    "probes": [
        "api key", "apikey", "api_key", "secret key", "secret token", "token bí mật", "system prompt", "mật khẩu", "password", "bỏ qua hướng dẫn", "previous instructions",
        "ignore instructions", "override instructions", "disregard instructions", "output keys", "đưa cho tôi api", "cho tôi api", "lấy api key", "show api key", "your api key", "api key của bạn",
        "cung cấp api key", "lộ key", "lộ api", "jailbreak", "prompt injection",
    ],
    "off_topic": [
        "thời tiết", "tin tức thế giới", "chứng khoán", "crypto", "bitcoin", "nấu ăn", "du lịch không liên quan", "y tế không liên quan", "weather", "world news", "stock market", "cryptocurrency", "cooking recipe",
        "travel itinerary", "medical diagnosis",
    ],
}
# Scripts and letters of other languages, Vietnamese letters, and words that speak for a language.
SCRIPTS = (
    r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{0400}-\x{04FF}\x{0500}-\x{052F}\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{0590}-\x{05FF}"
    r"\x{0E00}-\x{0E7F}\x{0E80}-\x{0EFF}\x{1780}-\x{17FF}\x{1000}-\x{109F}\x{0900}-\x{097F}\x{0980}-\x{09FF}\x{0A80}-\x{0AFF}\x{0B00}-\x{0B7F}\x{0B80}-\x{0BFF}\x{0C00}-\x{0C7F}\x{0C80}-\x{0CFF}\x{0D00}-\x{0D7F}\x{0370}-\x{03FF}]"
)
FOREIGN_LETTERS = "[äöüßÄÖÜẞçœæÇŒÆñÑ¿¡ąęłśźżćńğşıİțșčšžřďťňůőűåøÅØĄĘŁŚŹŻĆŃĞŞȚȘČŠŽŘĎŤŇŮŐŰ]"
VIETNAMESE_LETTERS = (
    "[àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
    "ÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴĐ]"
)
FOREIGN = (
    "bonjour bonsoir merci cherche recherche emploi travail poste postes candidat candidats recrutement dans avec pour vous nous ils elle suis une les des sur par qui que faire quelles sont cette ces salut bien vouloir "
    "évaluer evaluer compétence compétences competence competences requise requises mon ton son notre votre leur développeur developpeur "
    "guten morgen abend danke bitte suche stelle stellen arbeit beruf bewerbung lebenslauf fähigkeiten kenntnisse ich sie wir nicht und der die das ein eine einer einem einen mit für fuer auf kann welche "
    "sind brauche woher warum diesen dieser bewerten softwareentwickler "
    "hola buenos dias días tardes noches gracias favor busco trabajo empleo puesto puestos vacante vacantes candidatos curriculum currículum habilidades experiencia para como cómo esta está estoy donde dónde cuales cuáles "
    "quiero necesito olá obrigado obrigada procuro vaga vagas curriculo currículo quais muito evalúa evalua disponibles pela ajuda desenvolvedor desarrollador "
    "ciao buongiorno buonasera grazie prego cerco lavoro competenze sono cosa dove voglio posso posizioni aperte quali "
    "konnichiwa arigatou arigato sayonara ohayou hajimemashite gozaimasu privet spasibo pozhaluysta rabota ischu"
).split()
VIETNAMESE = (
    "toi tôi minh mình ban bạn cac các nhung những viec việc lam làm tim tìm cong công tuyen tuyển dung dụng ung ứng vien viên ho hồ so sơ danh sach sách phu phù hop hợp cho tai tại voi với ve về de để co có khong không "
    "nao nào gi gì sao the thế can cần hoc học diem điểm manh mạnh yeu yếu chua chưa chao chào xin cam cảm on ơn tot tốt kem kém nhieu nhiều it ít cao thap thấp muc mức luong lương kinh nghiem nghiệm ky kỹ nang năng nganh ngành "
    "nghe nghề vi vị tri trí ty fpt vng viettel shopee tiki momo zalo coccoc hcm tphcm hanoi danang ha noi da nang sai gon saigon tro ly giup do huong dan lo trinh bo sung them cai thien danh gia cham duoi tren theo tu cua nhan su lap trinh "
    "phat trien kiem toan ke tai chinh ngan hang ban hang kho van chuoi cung ung an toan thong tin"
).split()
ENGLISH = (
    "a about above after again against ai all am an and any are as at backend be because been before being below best between both browse but by can candidate candidates cloud company compare cv data "
    "developer devops do does doing down during each engineer engineering evaluate evaluation experience few filter find fit for from frontend fullstack further gap get give good had has have having he hello "
    "help her here hers herself hey hi him himself his how i if in into is it its itself java javascript jd job jobs just kubernetes learn list logistic logistics looking machine marketing match matching "
    "me ml mobile more most my myself need no nor not now of off on once only open opening openings or other our ours ourselves out over own please position positions profile python rate react recommend "
    "recommendation recruiter recruitment remote resume review role roles salary same search senior she should show skill skills so software some such suitable tech than thank thanks that the their theirs them "
    "themselves then there these they this those through to too top under until up us very want was we were what when where which while who whom why with work working would you your yours yourself yourselves"
).split()
#: Which rule fires first decides: stage, intent, whether tables, a profile, a profile of one's own and vectors are needed, and who answers.
RULES = [
    ("empty", "unknown", False, False, False, False, None),
    ("script", "unsupported_language", False, False, False, False, None),
    ("language", "unsupported_language", False, False, False, False, None),
    ("unsafe", "out_of_scope", False, False, False, False, None),
    ("chat", "chitchat", False, False, False, False, None),
    ("off_topic", "out_of_scope", False, False, False, False, None),
    ("screen", "recruiter_screen", True, True, False, True, "matching"),
    ("skill_gap", "skill_gap_advice", False, True, True, False, "evaluation"),
    ("evaluate", "self_evaluate", False, True, True, False, "evaluation"),
    ("list", "list_available_jobs", True, False, False, True, "recommend"),
    ("browse_domain", "search_by_domain", True, False, False, True, "recommend"),
    ("browse_target", "target_specific", True, False, False, True, "recommend"),
    ("own_cv", "recommend_general", True, True, True, True, "recommend"),
    ("company", "target_specific", True, False, False, True, "recommend"),
    ("generic", "recommend_general", True, True, True, True, "recommend"),
    ("domain", "search_by_domain", True, False, False, True, "recommend"),
    ("recruitment", "unknown", False, False, False, False, None),
    ("other", "out_of_scope", False, False, False, False, None),
]
SHORT = 3


def fold(phrase: str) -> str:
    """A phrase of the lists above as it stands in the folded view."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", phrase).casefold() if not unicodedata.combining(c))
    return " ".join(plain.replace("đ", "d").split())


def is_short(phrase: str) -> bool:
    """Whether a phrase counts only as whole words."""
    return len(fold(phrase)) <= SHORT and fold(phrase).isalnum()


def says(view: Column, phrases: list[str]) -> Column:
    """The first of the phrases that the folded view says, null for none: short ones as whole words, others anywhere. One scan by one pattern."""
    long = "|".join(dict.fromkeys(re.escape(fold(p)) for p in phrases if not is_short(p)))
    short = "|".join(dict.fromkeys(fold(p) for p in phrases if is_short(p)))
    pattern = "|".join(x for x in (long, rf"(?U)\b(?:{short})\b" if short else "") if x)
    return F.nullif(F.regexp_extract(view, f"({pattern})", 1), F.lit(""))


def location(view: Column) -> Column:
    """The first of the places that the folded view holds."""
    return F.coalesce(*(F.when(F.contains(view, F.lit(fold(p))), F.lit(p)) for p in LOCATIONS))


def company(view: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(view, F.lit(fold(p))), F.lit(p)) for p in COMPANIES))


def domain(view: Column) -> Column:
    """The first of the fields that the folded view names as whole words."""
    hit = lambda p: F.contains(view, F.lit(fold(p))) & view.rlike(rf"(?U)(?<!\w){re.escape(fold(p))}(?!\w)")
    return F.coalesce(*(F.when(hit(p), F.lit(p)) for p in DOMAINS))


def job_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?U)#(\d+)", 1), F.lit(""))


def language(text: Column) -> Column:
    """vi or en; null for texts in another script or language, and without any.

    Scripts and letters of others decide at once; else words vote, and Vietnamese letters outweigh the votes but for foreign words.
    """
    known = ENGLISH + [w for w in DOMAINS + COMPANIES + LOCATIONS if re.fullmatch(r"[^\W\d_]+", w)]
    within = lambda w, of: F.filter(w, lambda x: x.isin(*dict.fromkeys(of)))

    def vote(t: Column, w: Column) -> Column:
        foreign, vi, en = (F.size(within(w, of)) for of in (FOREIGN, VIETNAMESE, known))
        decide = lambda n: F.when((n["f"] >= 1) & (n["f"] >= n["v"]) & (n["f"] >= n["e"]), None).when(t.rlike(VIETNAMESE_LETTERS), "vi").when(n["v"] > n["e"], "vi").otherwise("en")
        return let(F.struct(foreign.alias("f"), vi.alias("v"), en.alias("e")), decide)

    def read(t: Column) -> Column:
        # the lists' words first: they are few of a text's, and each list looks only at them
        listed = within(words(t), FOREIGN + VIETNAMESE + known)
        return F.when((t != "") & ~t.rlike(SCRIPTS) & ~t.rlike(FOREIGN_LETTERS), let(listed, lambda w: vote(t, w)))

    return let(trimmed(F.coalesce(text, F.lit(""))), read)


def off_topic(view: Column) -> Column:
    """Whether two phrases of other topics are said, or one with no word about work."""
    n = reduce(lambda a, b: a + b, (says(view, [p]).isNotNull().cast("int") for p in SAYS["off_topic"]))
    return (n >= 2) | ((n > 0) & says(view, SAYS["topic_with_work"]).isNull())


def sensitive(text: Column) -> Column:
    """Whether a text holds a telephone number of ten digits or a mail address."""
    return text.rlike(r"(?U)\b\d{3}[-\s]?\d{3}[-\s]?\d{4}\b") | text.rlike(r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b")


def rejected(text: Column, least: int = 100, most: int = 50_000, lang: Column | None = None) -> Column:
    """Why a text is not taken on: too little in it, too long, or in another language; null if it is taken. lang: its language, if it is there already."""
    t = F.coalesce(text, F.lit(""))
    short = F.length(trimmed(t)) < least
    return F.when(short, "minimum_content_not_met").when(F.length(t) > most, "malformed_request").when((language(t) if lang is None else lang).isNull(), "unsupported_language")


def routed(text: Column, view: Column) -> Column:
    """struct<stage, intent, needs_db, needs_cv, requires_user_cv, needs_vector_search, target, said, location, domain, company_name, target_job_num>:
    the first rule that fits, what was said for it, and the names that it goes by; null counts as empty. view: the text, folded."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")

    def look(t: Column) -> Column:
        def read(view: Column) -> Column:
            keys = ["probes", "off_topic", "chats", "chat_with_work", "screens", "lacks", "evaluates", "lists", "browses", "uses_cv", "wants_jobs", "recruits"]
            seen = F.struct(
                *(says(view, SAYS[k]).alias(k) for k in keys), language(t).alias("language"), off_topic(view).alias("astray"), location(view).alias("location"), domain(view).alias("domain"),
                company(view).alias("company"), job_number(t).alias("number"),
            )
            return let(seen, lambda s: decide(t, s))

        return let(view, read)

    def decide(t: Column, s: Column) -> Column:
        has = lambda k: s[k].isNotNull()
        browse = has("browses") & (has("location") | has("domain") | has("company") | has("number")) & ~has("uses_cv")
        tests = {
            "empty": t == "", "script": t.rlike(r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"), "language": s["language"].isNull(), "unsafe": has("probes") | s["astray"],
            "chat": has("chats") & ~has("chat_with_work"), "off_topic": has("off_topic"), "screen": has("screens"), "skill_gap": has("lacks"), "evaluate": has("evaluates"), "list": has("lists"),
            "browse_domain": browse & has("domain"), "browse_target": browse, "own_cv": has("uses_cv"), "company": has("company"), "generic": has("wants_jobs"), "domain": has("domain"), "recruitment": has("recruits"), "other": F.lit(True),
        }
        said = {"unsafe": "probes", "chat": "chats", "off_topic": "off_topic", "screen": "screens", "skill_gap": "lacks", "evaluate": "evaluates", "list": "lists", "browse_domain": "browses", "browse_target": "browses", "own_cv": "uses_cv", "company": "company", "generic": "wants_jobs", "domain": "domain", "recruitment": "recruits"}
        named = {"list": ("location", "domain"), "browse_domain": ("location", "domain", "company", "number"), "browse_target": ("location", "domain", "company", "number"), "own_cv": ("location", "domain"), "company": ("company",), "domain": ("domain",), "skill_gap": ("domain",)}

        def answer(rule: tuple) -> Column:
            stage, intent, db, cv, own, vector, target = rule
            goes = lambda k: (s[k] if k in named.get(stage, ()) else F.lit(None).cast("string"))
            return F.struct(
                F.lit(stage).alias("stage"), F.lit(intent).alias("intent"), F.lit(db).alias("needs_db"), F.lit(cv).alias("needs_cv"), F.lit(own).alias("requires_user_cv"), F.lit(vector).alias("needs_vector_search"),
                F.lit(target).cast("string").alias("target"), (s[said[stage]] if stage in said else F.lit(None).cast("string")).alias("said"),
                goes("location").alias("location"), goes("domain").alias("domain"), goes("company").alias("company_name"), goes("number").alias("target_job_num"),
            )

        return F.coalesce(*(F.when(tests[r[0]], answer(r)) for r in RULES))

    return let(raw, look)
