"""Text functions: tokens, chunks, normal forms, detection, assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = ["the", "is", "a", "an", "of", "to", "in", "and", "or", "for", "on", "with", "what", "how", "my", "i"]
HINGLISH = {"kahan hai": "where is", "kab aayega": "when will arrive", "nahi mila": "not received", "wapas": "return", "paisa": "money", "kitna": "how much"}
MODES = [("act", r"(?i)\b(cancel|refund|update|create|delete|book)\b"), ("diagnose", r"(?i)\b(why|error|failed|issue|problem|stuck)\b"), ("explain", r"(?i)\b(how|explain|what is|meaning)\b")]


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and _ of more than two characters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0), lambda x: F.length(x) > 2)


def plain_words(text: Column, stop: list[str] = STOP) -> Column:
    """Words once other signs are dropped, without stop words, repeats kept."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+"), lambda x: (x != "") & ~x.isin(stop))


# Words that say nothing in a question or an answer of the knowledge base.
FAQ_STOP = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into through during before "
    "after above below and but or nor not so yet both either neither each every all any few more most other some such no only same than too very just because if when where how "
    "what which who whom this that these those i me my we our you your he him his she her it its they them their"
).split()


def faq_words(text: Column) -> Column:
    """Words of letters and digits, without the stop words of questions, repeats kept."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: (x != "") & ~x.isin(FAQ_STOP))


# Which mode of question each kind of document helps with.
QUERY_MODES = {
    "lookup": "schema schema_identity schema_states catalog table_index json_keys api_overview api_registry tool_registry entity_def intent_def agent_def "
    "page_field_trace page_intelligence access_pattern cross_repo_page_mapping",
    "diagnose": "workflow_state_machine workflow_exception_paths workflow_decision_matrix action_failure_modes workflow_data_flow workflow_eval_cases operator_runbook",
    "act": "action_contract action_execution_graph action_permissions action_rollback action_data_access workflow_action_map workflow_operator_playbook",
    "explain": "action_intent_map action_examples action_observability workflow_overview workflow_async_map workflow_user_language workflow_ui_map workflow_entrypoints",
    "routing": "negative_routing action_eval_cases",
}
CAPABILITY_MODES = {"action": "act", "workflow": "diagnose", "routing": "routing"}


def document_mode(source_type: Column, chunk_type: Column, capability: Column, file_type: Column, modes: dict[str, str] = QUERY_MODES) -> Column:
    """Mode of the first of source type, chunk type, capability_file type and file type that has one; else of the capability, else
    lookup."""
    known = F.create_map(*[F.lit(x) for mode, names in modes.items() for name in names.split() for x in (name, mode)])
    steps = [source_type, chunk_type, F.when(file_type != "", F.concat_ws("_", capability, file_type)), file_type]
    rest = F.create_map(*[F.lit(x) for pair in CAPABILITY_MODES.items() for x in pair])
    return F.coalesce(*[F.element_at(known, s) for s in steps], F.element_at(rest, capability), F.lit("lookup"))


def word_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9_]+"), 0)))


def semantic_chunks(text: Column, header: Column, classes: list[tuple[str, str]], least: int = 200, most: int = 3600, separator: str = " | ") -> Column:
    """array<struct<chunk_type, body>>: short texts as they are; longer ones as one chunk for each class of sections under the
    header, chunks under `least` characters left out, bodies cut at `most`. classes: (name, pattern), first match; else main."""
    parts = F.transform(F.split(text, r" \| "), lambda x: F.trim(x))
    kind = lambda s: reduce(lambda c, p: c.when(F.lower(s).rlike(p[1]), p[0]), classes[1:], F.when(F.lower(s).rlike(classes[0][1]), classes[0][0])).otherwise("main")
    of = lambda n: F.filter(parts, lambda s: kind(s) == n)
    every = F.array(*[F.struct(F.lit(n).alias("chunk_type"), F.substring(F.concat_ws(separator, header, F.array_join(of(n), separator)), 1, most).alias("body")) for n in ["main", *[c for c, _ in classes]]])
    whole = F.array(F.struct(F.lit("main").alias("chunk_type"), F.substring(text, 1, most).alias("body")))
    big = F.filter(every, lambda c: F.length(c["body"]) >= least)
    return F.when(F.length(text) <= most, whole).when(F.size(big) > 0, big).otherwise(whole)


def paragraph_chunks(text: Column, most: int = 2000) -> Column:
    """Paragraphs packed in order into chunks of at most `most` characters (a longer paragraph is a chunk)."""
    start = F.array().cast("array<string>")

    def add(acc, p):
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last) + F.length(p) + 2 <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit("\n\n"), p)))).otherwise(F.array_append(acc, p))

    return F.aggregate(F.split(text, "\n\n"), start, add)


def digest(text: Column, n: int = 32) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def point_id(repo: Column, kind: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", repo, kind, key))


def cache_key(text: Column) -> Column:
    """sha256 prefix of the text in lower case, white space collapsed, punctuation dropped."""
    return digest(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+", " ")), 16)


def pattern_key(text: Column) -> Column:
    """Numbers as {id}, codes of eight signs or more as {awb}, blanks as _, 100 characters."""
    out = F.regexp_replace(F.lower(F.trim(text)), r"\d{5,}", "{id}")
    out = F.regexp_replace(out, r"\b[a-z0-9]{8,}\b", "{awb}")
    out = F.regexp_replace(out, r"\b(please|kindly|can you|could you)\s*", "")
    return F.substring(F.regexp_replace(out, r"\s+", "_"), 1, 100)


def tool_name(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, "[^a-zA-Z0-9_]", "_"), 1, 64)


def questions(text: Column, most: int = 3) -> Column:
    """Parts of a compound question, each of more than five characters."""
    parts = F.filter(F.transform(F.split(text, r"(?i)\s+(?:and also|and|also|aur|then)\s+|[?;]\s*"), lambda x: F.trim(x)), lambda x: F.length(x) > 5)
    return F.when(F.size(parts) > 0, F.slice(parts, 1, most)).otherwise(F.array(text))


def translated(text: Column, phrases: dict[str, str] = HINGLISH) -> Column:
    """Phrases replaced whole, longest first."""
    return reduce(lambda c, p: F.regexp_replace(c, rf"(?i)\b{p}\b", phrases[p]), sorted(phrases, key=len, reverse=True), text)


def query_mode(text: Column) -> Column:
    out = F.when(text.rlike(MODES[0][1]), MODES[0][0])
    for name, pattern in MODES[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("lookup")


def classify(text: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<intent, confidence>: intents whose pattern hits; one hit 0.95, several 0.75 for the first, none unknown 0.35."""
    found = F.filter(F.array(*[F.when(text.rlike(p), n) for n, p in rules]), lambda x: x.isNotNull())
    return F.struct(F.coalesce(F.get(found, F.lit(0)), F.lit("unknown")).alias("intent"), F.when(F.size(found) == 1, 0.95).when(F.size(found) > 1, 0.75).otherwise(0.35).alias("confidence"))


def domain_score(text: Column, domains: dict[str, list[str]]) -> Column:
    """struct<domain, confidence>: most pattern hits (first of equals); confidence min(.95, .5 + .08 hits)."""
    n = {d: sum((text.rlike(p).cast("int") for p in ps), F.lit(0)) for d, ps in domains.items()}
    top = F.greatest(*n.values(), F.lit(0))
    name = reduce(lambda c, d: c.when((n[d] == top) & (top > 0), d), list(n)[1:], F.when((n[next(iter(n))] == top) & (top > 0), next(iter(n)))).otherwise("general")
    return F.struct(name.alias("domain"), F.least(F.lit(0.95), 0.5 + 0.08 * top).alias("confidence"))


def entities(text: Column) -> Column:
    """struct<company, awb, orders>."""
    got = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.struct(got(r"(?i)(?:company|seller|client|cid|client_id|company_id)[\s_]*(?:id)?[\s:=#]*(\d{3,10})").alias("company"), got(r"(?i)\b(?:awb|tracking|track)[:\s#-]*([A-Z0-9]{8,20})\b").alias("awb"), F.regexp_extract_all(text, F.lit(r"\b(\d{7,12})\b"), 1).alias("orders"))


def keyword_map(text: Column, map_: dict[str, str]) -> Column:
    """Values of the keywords the text holds, distinct, in order."""
    return F.array_distinct(F.filter(F.array(*[F.when(F.contains(F.lower(text), F.lit(k)), v) for k, v in map_.items()]), lambda x: x.isNotNull()))


def claims(text: Column) -> Column:
    """Sentences with a number or a verb of state."""
    return F.filter(F.transform(F.split(text, r"[.!?]\s+"), lambda x: F.trim(x)), lambda s: s.rlike(r"(?i)\d|\b(is|are|was|has|will)\b"))


def support(claim: Column, context: Column) -> Column:
    """Share of the claim's distinct words the context's words hold."""
    return F.when(F.size(claim) > 0, F.size(F.array_intersect(claim, context)) / F.size(F.array_distinct(claim))).otherwise(0.0)


def clean_faq(text: Column, least: int = 20) -> Column:
    """Without URLs and doubled blanks; null under `least` words."""
    out = F.trim(F.regexp_replace(F.regexp_replace(text, r"https?://\S+", ""), r"\s+", " "))
    return F.when(F.size(F.split(out, " ")) >= least, out)


def path_entity(path: Column, marker: str) -> Column:
    """The path segment after the marker, else the last one."""
    parts = F.split(path, "/")
    at = F.array_position(parts, marker)
    return F.coalesce(F.when(at > 0, F.get(parts, at.cast("int"))), F.element_at(parts, -1))


def resource_action(method: Column, path: Column) -> Column:
    """resource_action of an API: last plain segment, and get/create/update/delete by method."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike(r"^(api|v\d+|\{.*\}|\d+)$"))
    verb = F.when(method == "GET", "get").when(method == "POST", "create").when(method.isin("PUT", "PATCH"), "update").when(method == "DELETE", "delete").otherwise("call")
    return F.concat_ws("_", F.coalesce(F.element_at(parts, -1), F.lit("root")), verb)


def tokens_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def sentence_cut(text: Column, most: int) -> Column:
    """text cut at most characters, at its last full stop or line end if that lies beyond the middle."""
    head = F.substring(text, 1, most)
    found = (F.instr(head, ".") > 0) | (F.instr(head, "\n") > 0)
    at = F.greatest(F.when(F.instr(head, ".") > 0, most - F.instr(F.reverse(head), ".") + 1).otherwise(0), F.when(F.instr(head, "\n") > 0, most - F.instr(F.reverse(head), "\n") + 1).otherwise(0))
    return F.when(F.length(text) <= most, text).when(found & (at > most / 2), F.substring(head, F.lit(1), at)).otherwise(head)


def identifiers(text: Column) -> Column:
    """snake_case and camelCase names."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([a-z]+_[a-z_]+|[a-z]+[A-Z][A-Za-z]+)\b"), 1))


def contextual_header(kind: Column, name: Column, domain: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit(" "), name, F.lit(" in "), F.coalesce(domain, F.lit("general")), F.lit("]"))


def generic(text: Column) -> Column:
    """An example that says nothing of its own."""
    return F.trim(F.lower(text)).rlike(r"^(example|sample|test|todo|query)\s*\d*$") | (F.length(F.trim(text)) < 10)


def prompt(title: Column, parts: Column) -> Column:
    """Numbered parts under a title, the strongest first and the next strongest last."""
    order = F.when(F.size(parts) > 2, F.concat(F.slice(parts, 1, 1), F.slice(parts, 3, F.size(parts)), F.slice(parts, 2, 1))).otherwise(parts)
    return F.concat_ws("\n", title, F.array_join(F.transform(order, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n"))
