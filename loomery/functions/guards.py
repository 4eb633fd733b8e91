"""Checks and masks of messages and responses, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns. (?i) ignores case. All but one, which looks ahead, read the same in RE2.
INJECTION = [
    r"(?i)ignore\s+(all\s+)?(previous|above|prior)\s+instructions",
    r"(?i)(you\s+are\s+now|act\s+as|pretend\s+to\s+be)",
    r"(?i)system\s*:",
    r"(?i)(show|output|reveal)\s+(your\s+)?(prompt|instructions|system)",
    r"(?i)(sudo|admin\s+mode|unrestricted|override)",
]
POISON = [
    r"(?i)ignore\s+(all\s+)?previous",
    r"(?i)disregard\s+.*instructions",
    r"(?i)you\s+are\s+now",
    r"(?i)new\s+instructions?\s*:",
    r"(?i)override\s+rules",
    r"(?i)<\s*system\s*>",
    r"(?i)\[INST\]",
    r"(?i)jailbreak",
]
HINGLISH_INJECTION = [
    r"(?i)(pichle|pehle|purane)\s+(instructions?|nirdesh|rules?)\s+(bhool|bhul|ignore|chhod|hatao)",
    r"(?i)(bhool|bhul|ignore|chhod)\s+(jao|karo|do)\s+.*(instructions?|rules?|nirdesh)",
    r"(?i)ab\s+se\s+(tu|tum|aap)\s+(ek|hai)",
    r"(?i)(rules?|niyam)\s+(tod|badal|change)\s+(do|karo)",
    r"(?i)(sab\s+kuch|sara\s+data|poora)\s+(dikha|batao|reveal)\s+(do|karo)",
    r"(?i)(ban\s+ja|ban\s+jao|acting\s+karo)\s+.*(admin|hacker|system)",
    r"(?i)(rules?|niyam)\s+(mat|nahi)\s+(mano|follow)",
    r"(?i)(mat|nahi)\s+(mano|follow)\s+(rules?|niyam|instructions?)",
    r"(?i)(mujhe|mereko)\s+(admin|full|poora)\s+(access|permission)\s+(do|de|dedo)",
    r"(?i)(system\s+prompt|instructions?)\s+(dikha|batao|show)\s+(do|karo)",
]
COMPANY = [r"(?i)company[\s_-]*(?:id)?[\s:=#]*(\d+)", r"(?i)seller[\s_-]*(?:id)?[\s:=#]*(\d+)", r"(?i)for\s+(?:company|seller|merchant)\s+(\w+)", r"(?i)(?:show|get|find|list)\s+.*\s+(?:company|seller)\s+(\w+)"]
COMPANY_SWITCH = [r"(?i)switch\s+to\s+(company|seller|account)", r"(?i)impersonate", r"(?i)as\s+(another|different|other)\s+(seller|company|merchant)"]
MASS_ACTION = [
    r"(?i)\b(cancel|delete|remove|refund)\s+(all|every|sab|sara|poore)\b",
    r"(?i)\b(all|every|sab|sara)\s+.{0,20}\s+(cancel|delete|remove|refund)\b",
    r"(?i)\b(bulk|mass)\s+(cancel|delete|refund|update)\b",
    r"(?i)\bdelete\s+(my\s+)?account\b",
    r"(?i)\bdeactivate\s+(my\s+)?account\b",
    r"(?i)\btrigger\s+rto\b",
    r"(?i)\bforce\s+(cancel|close|delete)\b",
    r"(?i)\bpermanently\s+(delete|remove)\b",
]
TABLES = ["orders", "shipments", "couriers", "wallets"]
RECOMMENDATION = [r"(?i)\b(try|use|switch\s+to|consider|recommend|better\s+to\s+use|go\s+with|opt\s+for)\b", r"(?i)\b(directly|their\s+portal|their\s+website|their\s+app)\b"]
LEAKS = [
    (r"(?i)\bcolumn\s+([\w.]+)\b", "field"),
    (r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN)\s+", "[query]"),
    (r"(?i)/internal/v\d+/[\w/.-]+", "[internal API]"),
    (r"(?i)/v\d+/auth/login/[\w?=&]+", "[auth endpoint]"),
    (r"(?i)localhost:\d{4,5}", "[internal service]"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?", "[server]"),
    (r"(?i)https?://[\w.-]+\.internal[\w./-]*", "[internal URL]"),
    (r"(?i)webhook\.[\w.]+", "notification system"),
    (r"(?i)\b(PostgreSQL|pgvector|NetworkX|Redis|Kafka|Elasticsearch)\b", "our system"),
    (r"Bearer\s+[A-Za-z0-9._-]{20,}", "Bearer [REDACTED]"),
    (r"eyJ[A-Za-z0-9._-]{20,}", "[REDACTED_TOKEN]"),
]
PROMISES = [
    (r"(?i)\b(i|we)\s+(guarantee|promise|assure|commit)\b", "Our team will do their best to"),
    (r"(?i)\b(guaranteed|promised|assured)\s+(delivery|refund|resolution)", "expected"),
    (r"(?i)\bwill\s+definitely\s+(be|get|receive|have)\b", "should"),
    (r"(?i)\b100%\s+(refund|guarantee|assured|certain)\b", "as per policy"),
    (r"(?i)\bwithin\s+\d+\s+(hours?|days?|minutes?)\s+(you will|your|it will|we will)\b", "as per our standard timeline,"),
    (r"(?i)\bby\s+tomorrow\s+(you will|it will|your)\b", "as per estimated delivery,"),
    (r"(?i)\b(₹|Rs\.?|INR)\s*[\d,]+\s+(will be|shall be)\s+(credit|refund|compensat)", "the applicable amount as per policy will be"),
    (r"(?i)\bfull\s+refund\s+(will|shall)\s+be\b", "refund as per policy will be"),
    (r"(?i)\bcompensation\s+of\s+(₹|Rs\.?|INR)\s*[\d,]+", "compensation as per applicable policy"),
]
MONEY_ALWAYS = [(r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "XXXX-XXXX-XXXX-****"), (r"(?i)\b\d{9,18}\b(?=.*(?:account|a/c|acc))", "XXXXXXXXX****"), (r"(?i)\bIFSC[\s:]*[A-Z]{4}0[A-Z0-9]{6}\b", "IFSC: XXXX0XXXXXX")]
MONEY_UNASKED = [(r"(₹|Rs\.?|INR)\s*[\d,]+\.?\d{0,2}", "₹***"), (r"(?i)\b\d{1,3}(,\d{3})+(\.\d{1,2})?\s*(rupees?|rs)\b", "*** rupees"), (r"(?i)\b\d+(\.\d+)?%\s*(commission|margin|rate)\b", r"**% \2")]
MONEY_WORDS = ["wallet", "balance", "billing", "invoice", "charge", "freight", "refund", "payment", "cod", "remittance", "cost", "price", "amount", "debit", "credit", "fee", "commission", "kitna paisa", "paise", "rupees", "rupaye"]
#: category: (pattern, risk)
THREATS = {
    "direct": [(r"(?i)ignore\s+(all\s+)?previous\s+instructions", 9), (r"(?i)disregard\s+(your\s+)?instructions", 9), (r"(?i)you\s+are\s+now\s+a", 9), (r"(?i)pretend\s+you\s+are", 8), (r"(?i)act\s+as\s+if", 7), (r"(?i)from\s+now\s+on\s+you\s+will", 9), (r"(?i)new\s+instructions?:?\s", 8), (r"(?i)override\s+(safety|security|rules|guardrail)", 9), (r"(?i)forget\s+(everything|all|your)\s+(you|about|previous)", 9), (r"(?i)do\s+not\s+follow\s+(your|the|any)\s+(rules|instructions|guidelines)", 9), (r"(?i)jailbreak", 9), (r"(?i)DAN\s+mode", 9)],
    "indirect": [(r"(?i)<\s*system\s*>", 8), (r"(?i)<\s*/?\s*system[-_]?prompt\s*>", 9), (r"(?i)\[INST\]", 8), (r"(?i)\[/INST\]", 8), (r"(?i)###\s*system", 7), (r"(?im)^Human:\s*", 7), (r"(?im)^Assistant:\s*", 7), (r"(?i)<\|im_start\|>", 9), (r"(?i)<\|im_end\|>", 9), (r"(?i)<\|endoftext\|>", 9), (r"(?i)<<SYS>>", 9), (r"(?i)<</SYS>>", 9)],
    "command": [(r"\$\(.*\)", 9), (r"`[^`]+`", 9), (r"(?i)base64\s+--decode", 9), (r"(?i)curl.*\|.*sh", 9), (r"(?i)wget.*\|.*sh", 9), (r">\s*/etc/", 9), (r"(?i)chmod\s+\+x", 9), (r"(?i)sh\s+-c", 9), (r"(?i)eval\s*\(", 8), (r"(?i)exec\s*\(", 8), (r"(?i)\brm\s+-rf\b", 9), (r"(?i)\bmkfs\b", 9), (r"(?i)\bdd\s+if=", 9), (r"(?i)\bshutdown\b", 8), (r"(?i)\breboot\b", 8)],
    "exfiltration": [(r"(?i)(show|print|reveal|display|output)\s+(\w+\s+)*(system\s+)?prompt", 8), (r"(?i)what\s+are\s+your\s+(instructions|rules|constraints|guidelines)", 7), (r"(?i)repeat\s+(everything|all)\s+(above|before|from\s+the\s+start)", 8), (r"(?i)(dump|leak|expose|exfiltrate)\s+.*\b(context|prompt|memory|config)\b", 9), (r"(?i)/etc/(passwd|shadow|sudoers)", 8), (r"(?i)\.(ssh|aws|env|bash_history)", 8), (r"(?i)(api[_-]?key|secret[_-]?key|password|token)\s*[:=]", 7)],
    "hijacking": [(r"(?i)(call|execute|run|invoke)\s+(the\s+)?(delete|drop|truncate|destroy)", 9), (r"(?i)use\s+tool\s*:?\s*(rm|delete|drop|destroy)", 9), (r"(?i)force\s+(call|execution|tool)", 8), (r"(?i)bypass\s+(auth|permission|guard|check|validation)", 9), (r"(?i)skip\s+(auth|verification|validation|approval)", 8), (r"(?i)sudo\b", 7), (r"(?i)admin\s+override", 8)],
    "obfuscation": [(r"[a-zA-Z0-9+/=]{40,}", 7), (r"\\x[0-9a-fA-F]{2}(\\x[0-9a-fA-F]{2}){3,}", 9), (r"\\u[0-9a-fA-F]{4}(\\u[0-9a-fA-F]{4}){3,}", 9), (r"&#x?[0-9a-fA-F]+;(&#x?[0-9a-fA-F]+;){3,}", 8), (r"(?i)atob\s*\(", 9), (r"(?i)String\.fromCharCode", 9)],
}


def hits(text: Column, patterns: list[str]) -> Column:
    """Any of the patterns occurs; null texts hit nothing."""
    return F.coalesce(reduce(Column.__or__, [text.rlike(p) for p in patterns], F.lit(False)), F.lit(False))


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Each rule reads what the ones before left; \\1 in a replacement is a group."""
    java = lambda to: re.sub(r"\\(\d)", r"$\1", to.replace("$", r"\$"))
    return reduce(lambda c, r: F.regexp_replace(c, r[0], java(r[1])), rules, text)


def mask_leaks(text: Column, privileged: Column | None = None, tables: list[str] = TABLES, own: list[tuple[str, str]] | None = None) -> Column:
    """Masks what a user may not see of the system. tables: names of its tables; own: patterns of its hosts and components
    with what stands for them. Privileged users lose tokens only."""
    full = replaced(text, [(rf"(?i)\b({'|'.join(tables)})\s+table\b", "[internal table]"), *LEAKS[:-2], *(own or []), *LEAKS[-2:]])
    return full if privileged is None else F.when(privileged, replaced(text, LEAKS[-2:])).otherwise(full)


def verdict(*checks: tuple[Column, str]) -> Column:
    """The action of the first check that holds, else ALLOW: what a list of guards in order decides."""
    out = F.when(checks[0][0], checks[0][1])
    for condition, action in checks[1:]:
        out = out.when(condition, action)
    return out.otherwise("ALLOW")


def mask_pii(text: Column) -> Column:
    """Cards, then 12-digit ids, phones, emails and tax ids, in that order: each mask reads what the ones before left."""
    text = F.regexp_replace(text, r"\b(?:\d{4}[\s-]?){3}\d{4}\b", "xxxx xxxx xxxx xxxx")
    text = F.regexp_replace(text, r"\b\d{4}[\s-]?\d{4}[\s-]?(\d{4})\b", "xxxx xxxx $1")
    text = F.regexp_replace(text, r"\b([6-9]\d)\d{5}(\d{3})\b", "$1xxxxx$2")
    text = F.regexp_replace(text, r"([a-zA-Z0-9._%+-]{2})[a-zA-Z0-9._%+-]+@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", "$1***@$2")
    return F.regexp_replace(text, r"\b([A-Z]{3})[A-Z]{2}\d{4}([A-Z])\b", "$1XXxxxx$2")


def access(role: Column, allowed: list[str], company: Column, target: Column) -> Column:
    return verdict((~role.isin(allowed), "BLOCK"), (target.isNotNull() & (company != target) & (company != "1"), "BLOCK"))


def rate_limited(df: DataFrame, key: str, at: str, most: int = 60, seconds: int = 60) -> DataFrame:
    """limited: more than `most` requests of the key in the last `seconds`, this one included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(at)).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("limited", F.count("*").over(w) > most)


def repeated(df: DataFrame, key: str, item: str, at: str, most: int = 5, seconds: int = 300) -> DataFrame:
    """abusive: besides this one, the same item (trimmed, in lower case) came `most` times or more from the key in less than the
    seconds before or at the same moment, so a burst counts too. Empty and null items are allowed. A looser rule, such as ten
    in ten minutes of queries that mean the same, is a second call on a column that names the meaning."""
    plain = F.lower(F.trim(item))
    w = Window.partitionBy(key, F.md5(plain)).orderBy(F.unix_micros(at)).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return df.withColumn("abusive", (F.count("*").over(w) - 1 >= most) & (F.coalesce(plain, F.lit("")) != ""))


def query_size(limit: Column, large: Column) -> Column:
    return verdict((limit > 500, "BLOCK"), (limit.isNull() & large, "BLOCK"))


def spend(confidence: Column, spent: Column, budget: float) -> Column:
    return verdict((confidence < 0.3, "BLOCK"), (spent > budget, "BLOCK"), (spent > 0.8 * budget, "WARN"))


def cross_tenant(text: Column, company: Column) -> Column:
    """BLOCK where the text names another company than the user's own, or asks to act as one; company 1 may ask for any."""
    named = F.filter(F.array(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in COMPANY]), lambda x: x.isNotNull())
    other = F.exists(named, lambda x: x != company)
    return F.when((company != "1") & F.coalesce(other | hits(text, COMPANY_SWITCH), F.lit(False)), "BLOCK").otherwise("ALLOW")


def poisoned(df: DataFrame, key: str, order: str, text: str, last: int = 10) -> DataFrame:
    """poisoned: one of the last turns of the session, this one included, holds an injected instruction."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(last - 1), 0)
    return df.withColumn("poisoned", F.max(hits(F.col(text), POISON).cast("int")).over(w) == 1)


def unsupported_ids(response: Column, context: Column) -> Column:
    """Numbers of 5 digits or more in the response that the context lacks."""
    return F.filter(F.array_distinct(F.regexp_extract_all(response, F.lit(r"\b\d{5,}\b"), 0)), lambda x: ~F.contains(context, x))


def grounding(response: Column, context: Column) -> Column:
    """Share of the response's words of more than three characters that the context holds as text; 1 if there is none."""
    words = F.filter(F.split(F.lower(response), r"[^a-z0-9]+"), lambda w: F.length(w) > 3)
    found = F.filter(words, lambda w: F.contains(F.lower(context), w))
    return F.when(F.size(words) > 0, F.size(found) / F.size(words)).otherwise(1.0)


def mask_money(response: Column, question: Column) -> Column:
    always = replaced(response, MONEY_ALWAYS)
    asked = reduce(Column.__or__, [F.contains(F.lower(question), F.lit(w)) for w in MONEY_WORDS])
    return F.when(asked, always).otherwise(replaced(always, MONEY_UNASKED))


def competitor(response: Column, brands: list[str]) -> Column:
    named = reduce(Column.__or__, [F.contains(F.lower(response), F.lit(b)) for b in brands])
    return F.when(named & hits(response, RECOMMENDATION), "BLOCK").otherwise("ALLOW")


def risk(text: Column) -> Column:
    """The largest risk of any threat pattern in the text, 0 if none."""
    return F.greatest(F.lit(0), F.lit(0), *[F.when(text.rlike(p), r).otherwise(0) for own in THREATS.values() for p, r in own])


def threats(text: Column) -> Column:
    """Categories with a hit, in order."""
    return F.filter(F.array(*[F.when(hits(text, [p for p, _ in own]), name) for name, own in THREATS.items()]), lambda x: x.isNotNull())


def safety(text: Column) -> Column:
    return F.when(risk(text) >= 7, "BLOCK").when(risk(text) >= 4, "WARN").otherwise("ALLOW")


def language_mismatch(question: Column, response: Column, hinglish: list[str]) -> Column:
    """The question is Hindi (over five Devanagari letters) and the response is not, or it is Hinglish (over .3 of its words)
    and the response is neither Hindi nor Hinglish (over .1 of its words)."""
    hindi = lambda c: F.regexp_count(c, F.lit(r"[\x{0900}-\x{097F}]")) > 5
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    share = lambda c: F.size(F.filter(words(c), lambda w: w.isin(hinglish))) / F.greatest(F.size(words(c)), F.lit(1))
    mixed = ~hindi(question) & (share(question) > 0.3)
    return ~hindi(response) & (hindi(question) | (mixed & (share(response) <= 0.1)))


def tool_scope(mode: Column, tools: Column, writing: list[str]) -> Column:
    return F.when((mode != "act") & F.arrays_overlap(tools, F.array(*map(F.lit, writing))), "BLOCK").otherwise("ALLOW")


def blast_radius(rows: Column) -> Column:
    return F.when(rows > 100, "BLOCK").when(rows > 10, "WARN").otherwise("ALLOW")


def mask_fields(json: Column, fields: list[str]) -> Column:
    return F.regexp_replace(json, rf'"({"|".join(fields)})": ?("[^"]*"|[0-9.]+)', '"$1": "***"')


def tagged(text: Column, trusted: Column) -> Column:
    """Text in a tag of its trust; what is untrusted loses its own tags."""
    return F.when(trusted, F.concat(F.lit("<trusted>"), text, F.lit("</trusted>"))).otherwise(F.concat(F.lit("<untrusted>"), F.regexp_replace(text, r"</?\w+>", ""), F.lit("</untrusted>")))


# What asks, what joins two questions, words that ground nothing.
ASKS = ["kya", "kahan", "kab", "kyun", "kitna", "kaun", "kaise", "what", "where", "when", "why", "how", "which", "status"]
JOINS = ["and", "aur", "also", "bhi", "saath", "plus", "along with"]
EMPTY = ["the", "and", "for", "are", "but", "not", "you", "all", "can", "this", "that", "with", "have", "from", "will", "your", "please", "based", "available", "information"]


def reflection(question: Column, response: Column, confidence: Column, intents: Column, entity: Column, context: Column, least: float = 0.5) -> Column:
    """What is wrong with a response, the worst first, or none: low_confidence; missing_intent (neither intent nor entity of one
    of intents, array<struct<intent, entity>>, is in it); wrong_entity (it lacks the entity's id); hallucination (under .3 of
    its words over four characters are in the context); incomplete (under .5, or too short for what was asked). A null entity
    or an empty context is not tested."""
    q, r = F.lower(question), F.lower(response)
    count = lambda words: sum((F.contains(q, F.lit(w)).cast("int") for w in words), F.lit(0))
    covered = lambda i: (i["entity"] == "unknown") | F.contains(r, F.lower(i["entity"])) | F.contains(r, F.lower(i["intent"]))
    terms = F.filter(F.array_distinct(F.split(r, r"\s+")), lambda w: (F.length(w) > 4) & ~w.isin(EMPTY))
    held = F.size(F.filter(terms, lambda w: F.contains(F.lower(context), w)))
    share = F.when((F.coalesce(context, F.lit("")) != "") & (F.size(terms) > 0), held / F.size(terms)).otherwise(1.0)
    short = ((count(ASKS) >= 2) & (F.length(response) < 50 * count(ASKS))) | ((count(JOINS) > 0) & (F.length(response) < 100))
    out = F.when(confidence < least, "low_confidence").when(F.exists(intents, lambda i: ~covered(i)), "missing_intent").when(entity.isNotNull() & ~F.contains(response, entity), "wrong_entity")
    return out.when(share < 0.3, "hallucination").when(short | (share < 0.5), "incomplete").otherwise("none")


def reflected(correction: Column) -> Column:
    """What follows where nothing could be mended."""
    return F.when(correction == "none", "pass").when(correction.isin("hallucination", "wrong_entity"), "escalate").otherwise("retry")


def write_action(text: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(text, r"(?i)\b(cancel|refund|update|delete|create|reattempt)\b", 1)), F.lit("")), F.lit("none"))
