"""Rules that give a row a label: what a question asks for, what may be shown, what a request gets. Expressions alone.

Patterns, words, thresholds and names of outcomes are what the rules are about; all stand here as fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, trimmed

_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def pattern(p: str) -> str:
    """``p`` with ASCII word edges and all white space, whatever the engine's own classes are."""
    out, inside, i = [], False, 0
    while i < len(p):
        two = p[i : i + 2]
        if two == r"\b" and not inside:
            out.append(_EDGE)
        elif two == r"\s":
            out.append(SPACES if inside else f"[{SPACES}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{SPACES}]")
        elif p[i] == "\\":
            out.append(two)
        else:
            inside = p[i] == "[" or inside and p[i] != "]"
            out.append(p[i])
            i += 1
            continue
        i += 2
    return "".join(out)


def found(text: Column, *patterns: str, ignore_case: bool = True) -> Column:
    """Whether any of the patterns stands in the text; false for null."""
    flag = "(?i)" if ignore_case else ""
    return F.coalesce(reduce(lambda a, b: a | b, [text.rlike(flag + pattern(p)) for p in patterns]), F.lit(False))


# ---- questions and answers. Fixed values -----------------------------------------------------------------------------

CRISIS = (
    r"\b(suicidal|suicide)\b",
    r"\b(kill|hurt|harm)(ing)?\s+(myself|my\s?self)\b",
    r"\bkill(ing)?\s+(him|her|them|someone|somebody)\b",
    r"\b(want|wanna|going|plan(ning)?)\s+to\s+die\b",
    r"\b(don'?t|do\s+not|no\s+longer)\s+want\s+to\s+(live|be\s+(here|alive))\b",
    r"\bend(ing)?\s+(my\s+life|it\s+all)\b",
    r"\b(take|taking|ending)\s+my\s+own\s+life\b",
    r"\b(better\s+off|rather\s+be)\s+dead\b",
    r"\bno\s+(reason|point)\s+(to\s+|in\s+)?(live|living|go\s+on)\b",
    r"\b(can'?t|cannot)\s+(go\s+on|keep\s+going)\b",
)
PERSON = r"\b(i|i'm|im|i've|ive|my|me|mine|you|your|we|our)\b"
ELIGIBILITY = (
    r"\b(?:dis|in|un|re)?(qualif|eligib|entitl)",
    r"\b(am i|what do i)\b",
    r"\bmy(?:\s+\S+){0,2}\s+(rating|claim|pay|bah|pension|payment|check|compensation|benefit|amount|account)s?",
    r"\b(do|can|could|will|would|may|might|won'?t|can'?t|wouldn'?t|couldn'?t|don'?t|didn'?t)\s+i\b[^?.!]{0,30}\b(get|receive|keep|draw|rate|collect|qualif|claim|file|lose)\b",
    r"\b(i|we)\s+(can|could|would|will|still)\b[^?.!]{0,20}\b(get|receive|keep|draw|rate|collect|qualif|claim|file|lose)\b",
    r"\b(bar|block|owe|cover)s?\s+(me|us)\b",
    r"\bcosts?\s+(me|us)\s+(my|the|our|a)\b",
    r"\bleaves?\s+(me|us)\s+(for|with|without|out\s+of)\b",
    r"\bput\s+in\s+for\b",
    r"\bcounts?\s+toward\b",
    r"\b(is|it'?s|that'?s|what'?s|still|now|even|really|not|all|and)\s+mine\b",
)
CRISIS_SIGNS = ("838255", "veteranscrisisline.net", "crisis line")
FALLBACKS = ("1-800-827-1000", "va.gov")
PERSONAL = (
    r"\byou(?:'re| are| may| might| could| will| would)?(?: be)? (?:qualif\w*|eligible|entitled)\b|\byou(?:'ll| will| can)? (?:get|receive)\b|"
    r"\byou (?:still )?have (?:until\b|(?:up to )?(?:\d+|a|an|one|two|three|six|twelve) (?:more )?(?:day|week|month|year)s?\b)|\bguarantee"
)
APPROVAL = (
    r"\byou(?:'re|'ve been|'d|'ll| are| were| have been| will| would| can| may| might| could| should)(?: (?:\w+ly|now|already|also))?(?: be| get)? approved\b|"
    r"(?<!(?<![A-Za-z0-9_])(?:whether|if|once|when|until) )\byour (?:\w+ )?(?:request|command|package|application|co|oic)(?: \w+){0,2} (?:is|was|has been|will|would|should|may|might|could|can)(?: (?:\w+ly|now|already|also))?(?: be| get)? approv\w*|"
    r"(?<!(?<![A-Za-z0-9_])who )\bwill approve your\b"
)
CHROME = ("was this page helpful?", "related articles", "related information", "related benefits & services", "browse by topic")
CONDITION = r"^(?:if|unless)\b"
QUESTION_BANK = r"Module Question\s+(?:Module\s+\d|Number\s+Answer)"
QUIZ = (r"\bQUIZ\s+TRUE\s+FALSE\b", QUESTION_BANK, r"(?:TRUE\s+FALSE\s+){3,}")
KEY_ROW = r"\b(?:Page|PG)\s+\d+\s+Module\s+\d"
STRUCTURE = r"</?(sources|user_question)\b[^>]*>"
DISCLAIMER = "AI-generated - verify against the official sources."
TRAILING_DISCLAIMER = r"\s*AI[-–— ]generated\s*[-–—]?\s*verify against the official sources\.?\s*$"
INERT = (r"(?i)\b(?:https?://|www\.)[^\s<>(),;]+", r"\+?\d[\d().\s-]{6,}\d", r"(?i)@[a-z0-9_]{2,}")


def asks_in_crisis(query: Column) -> Column:
    return found(query, *CRISIS)


def asks_of_eligibility(query: Column) -> Column:
    """Whether a question speaks of a person and of what that person would get."""
    return found(query, PERSON) & found(query, *ELIGIBILITY)


def names_crisis_line(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.rlike("(?<![0-9])988(?![0-9])") | reduce(lambda a, b: a | b, [low.contains(s) for s in CRISIS_SIGNS])


def names_fallback(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(s) for s in FALLBACKS])


def claims_personally(line: Column) -> Column:
    """Whether a line says what its reader qualifies for, gets, has left, or is approved for."""
    straight = F.translate(line, "’", "'")
    return found(straight, PERSONAL, APPROVAL)


def violated(answer: Column, section: Column) -> Column:
    """Names of the rules that an answer breaks."""
    text, no = trimmed(F.coalesce(answer, F.lit(""))), F.lit(False)
    governed = F.coalesce(found(trimmed(section), CONDITION), no) & ~found(text, CONDITION)
    rules = {
        "condition-attached": governed,
        "no-graded-exercise": found(answer, *QUIZ),
        "no-page-chrome": F.lower(text).isin(*CHROME),
        "no-answer-key-row": found(answer, KEY_ROW),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def without_structure(query: Column) -> Column:
    """A question without tags that stand for parts of a prompt."""
    return F.regexp_replace(query, "(?i)" + pattern(STRUCTURE), " ")


def inert(text: Column) -> Column:
    """URLs, runs like phone numbers, and handles, by kind and place, trimmed."""
    return F.transform(F.concat(*[F.regexp_extract_all(text, F.lit(pattern(p)), F.lit(0)) for p in INERT]), trimmed)


def outcome(stop: Column, cited: Column, retrieved: Column, text: Column, ungrounded: Column) -> Column:
    """What a written answer comes to, first match wins: crisis, serviceFailed, cutShort, notCovered, invalid_citation,
    no_citations, ungrounded_number or answer. ``cited`` and ``retrieved`` are arrays of ids, ``ungrounded`` of numbers."""
    valid = F.size(F.array_intersect(cited, retrieved))
    return (
        F.when((valid == 0) & names_crisis_line(text), "crisis")
        .when(stop == "refusal", "serviceFailed")
        .when(stop == "max_tokens", "cutShort")
        .when((valid == 0) & names_fallback(text), "notCovered")
        .when(F.size(F.array_except(cited, retrieved)) > 0, "invalid_citation")
        .when(F.size(cited) == 0, "no_citations")
        .when(F.size(ungrounded) > 0, "ungrounded_number")
        .otherwise("answer")
    )


def view_of(kind: Column) -> Column:
    """What is shown for the kind of a written answer: refusals are one, degraded is unavailable, all others are themselves."""
    return F.when(kind == "degraded", "unavailable").otherwise(kind)


def shown_answer(eligibility: Column, synthesis: Column, extract: Column) -> Column:
    """(kind, note) of what takes the answer's place, null for nothing. ``synthesis`` is the view's kind or null, ``extract``
    the extracted text or null. A question of eligibility never gets a written answer."""
    gate = F.coalesce(eligibility, F.lit(False)) | F.coalesce(synthesis == "eligibility", F.lit(False))
    has = F.coalesce(extract != "", F.lit(False))
    note = F.when(synthesis == "refusal", "refused").when(synthesis.isin("unavailable", "keyRejected", "serviceFailed", "cutShort"), synthesis).when(gate & (synthesis == "answer"), "suppressed")
    shown = lambda kind, n=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if n is None else n).alias("note"))
    return (
        F.when(gate & has, shown("extractive", note))
        .when(gate, shown("eligibility"))
        .when(synthesis == "notCovered", shown("notCovered"))
        .when(synthesis == "answer", shown("synthesized"))
        .when(has, shown("extractive", note))
    )


# ---- requests. Fixed values ------------------------------------------------------------------------------------------

ROUTES = ("/", "/timeline", "/ask", "/resources", "/settings", "/documents", "/about", "/feedback")
LONGEST_MESSAGE, LONGEST_ADDRESS = 4000, 254
ADDRESS = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def capped(query: Column, most: int) -> Column:
    """The first ``most`` characters of the trimmed question."""
    return F.left(trimmed(query), F.lit(most))


def origin_allowed(origin: Column, allowed: list[str]) -> Column:
    return F.coalesce(origin.isin(*allowed), F.lit(False))


def only_keys(payload: Column, allowed: list[str]) -> Column:
    """Whether a JSON object has no other keys; null for what isn't an object."""
    return F.size(F.array_except(F.json_object_keys(payload), F.array(*map(F.lit, allowed)))) == 0


def known_route(path: Column) -> Column:
    """A route without query and fragment if it is one of ROUTES, else null."""
    clean = F.substring_index(F.substring_index(path, "?", 1), "#", 1)
    return F.when(clean.isin(*ROUTES), clean)


def feedback_fault(message: Column, address: Column, trap: Column) -> Column:
    """Why feedback is turned away: spam, empty, too_long or bad_email; null if it isn't."""
    text, to = trimmed(F.coalesce(message, F.lit(""))), trimmed(F.coalesce(address, F.lit("")))
    bad = (F.length(to) > LONGEST_ADDRESS) | ~found(to, ADDRESS)
    return F.when(trimmed(F.coalesce(trap, F.lit(""))) != "", "spam").when(text == "", "empty").when(F.length(text) > LONGEST_MESSAGE, "too_long").when((to != "") & bad, "bad_email")


def feedback_decision(fault: Column, limited: Column) -> Column:
    return F.when(fault.isNotNull(), "reject").when(limited, "limited").otherwise("send")


def retrieval_status(method: Column, allowed: Column, query: Column, limited: Column, tripped: Column, failed: Column, hits: Column, most: int) -> Column:
    """What a request for passages gets: 405, 403, error, empty, high_demand or results, first match wins. ``query`` is null
    where it isn't text; what can't be known any more after a fault is an error, never empty."""
    return (
        F.when(~F.coalesce(method == "POST", F.lit(False)), "405")
        .when(~F.coalesce(allowed, F.lit(False)), "403")
        .when(query.isNull(), "error")
        .when(capped(query, most) == "", "empty")
        .when(limited | tripped, "high_demand")
        .when(failed, "error")
        .when(hits == 0, "empty")
        .otherwise("results")
    )


def handshake(status: Column, version: Column, accepted: str, has_results: Column) -> Column:
    """What a reply of the service counts as: results and empty only with the accepted version (and results with a list of them),
    high_demand as it is, all else, null too, as error."""
    fits = version.eqNullSafe(F.lit(accepted))
    whole = (status == "results") & fits & F.coalesce(has_results, F.lit(False))
    return F.when(F.coalesce(whole, F.lit(False)) | F.coalesce((status == "empty") & fits, F.lit(False)) | F.coalesce(status == "high_demand", F.lit(False)), status).otherwise("error")


def client_action(status: Column) -> Column:
    return F.when(status == "results", "render").when(status == "empty", "no_source").when(status == "high_demand", "degrade").otherwise("service_unavailable")


def next_rung(online_failed: Column, device_failed: Column, capable: Column) -> Column:
    """Where to go on after failures: the device, the network, or outside."""
    return F.when(online_failed & device_failed, "outbound_hub").when(online_failed & capable, "offer_device").when(online_failed, "outbound_hub").when(device_failed, "offer_online").otherwise("outbound_hub")


def answer_health(status: Column, body_status: Column, version: Column, accepted: str) -> Column:
    """Why a live answer isn't well: http, no_results or version; null if it is."""
    return F.when(~status.eqNullSafe(F.lit(200)), "http").when(~body_status.eqNullSafe(F.lit("results")), "no_results").when(~version.eqNullSafe(F.lit(accepted)), "version")


def build_landed(payload: Column, merged_at: Column) -> Column:
    """Whether the build stamp in a JSON object is from ``merged_at`` (milliseconds) or later; null for no stamp."""
    stamp = F.get_json_object(payload, "$.version")
    return F.when(stamp.rlike("^[0-9]+$"), stamp.cast("decimal(38,0)") >= merged_at)


# ---- phrases, versions, samples --------------------------------------------------------------------------------------

PHRASE_WORDS = 6


def phrase_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), f"[{SPACES}]+"), lambda w: w != "")


def phrase_fault(words: Column) -> Column:
    """(code, position, numbers) of what is wrong with a phrase of six plain words; code null if nothing is."""
    bad = F.array_position(F.transform(words, lambda w: w.rlike("^[a-z]+$")), F.lit(False)).cast("int")
    code = F.when(F.size(words) != PHRASE_WORDS, "words").when(bad > 0, "letters")
    return F.struct(code.alias("code"), F.when(code == "letters", bad).alias("position"), F.when(code == "words", F.exists(words, lambda w: w.rlike("[0-9]"))).alias("numbers"))


def first_difference(typed: Column, words: Column) -> Column:
    """The first position (from 1) at which two arrays of words differ; null if they don't."""
    return F.nullif(F.array_position(F.zip_with(typed, words, lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int"), F.lit(0))


def compared_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two versions of dotted numbers; missing parts are 0."""
    part = lambda v, k: F.coalesce(F.get(F.split(v, "\\."), F.lit(k)).cast("long"), F.lit(0))
    out = F.lit(0)
    for k in (2, 1, 0):
        out = F.when(part(a, k) < part(b, k), -1).when(part(a, k) > part(b, k), 1).otherwise(out)
    return out


def sampled_index(draw: Column, n: int, span: int = 65_536) -> Column:
    """An unbiased index below ``n`` from a draw below ``span``; null for draws that would favour some."""
    return F.when(draw < span - span % n, draw % n)


def margin(growth: Column) -> Column:
    """A tenth of growth, rounded up."""
    return F.ceil(F.greatest(growth, F.lit(0)) * F.lit("0.1").cast("decimal(2,1)")).cast("long")


# ---- days and plans. Fixed values ------------------------------------------------------------------------------------

ASK_AGAIN, LAST_ASK = 456, 21
COOLDOWN_MS, MOST_DISMISSALS = 72 * 3_600_000, 3
PAST_YEARS, FUTURE_YEARS = 5, 15
SNOOZES = (7, 30, 90)


def local_day(at: Column, zone: str) -> Column:
    """The day of a UTC time in a zone."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def snoozed_until(today: Column, days: Column | int) -> Column:
    """The day to which a snooze of so many days puts something off; presets are SNOOZES."""
    return F.date_add(today, days if isinstance(days, Column) else F.lit(days))


def days_left(anchor: Column, today: Column) -> Column:
    return F.date_diff(anchor, today)


def years_on(day: Column, years: int) -> Column:
    """The same day of another year; where there is none, March 1."""
    leap = (F.month(day) == 2) & (F.day(day) == 29)
    moved = F.add_months(day, 12 * years)
    return F.when(leap & (F.day(moved) != 29), F.date_add(moved, 1)).otherwise(moved)


def within_reach(day: Column, today: Column) -> Column:
    """Whether a day lies from five years before today to fifteen after it."""
    return day.between(years_on(today, -PAST_YEARS), years_on(today, FUTURE_YEARS))


def alarm_trigger(days: Column) -> Column:
    """Nine o'clock, so many days before, as a calendar duration."""
    return F.when(days == 1, "-PT15H").otherwise(F.concat(F.lit("-P"), (days - 1).cast("string"), F.lit("DT15H")))


def card_shown(dismissed_at: Column, count: Column, now: Column) -> Column:
    """Whether a dismissed card shows again: after three days, and never after the third time."""
    return (F.coalesce(count, F.lit(0)) < MOST_DISMISSALS) & F.coalesce(now - dismissed_at >= COOLDOWN_MS, F.lit(True))


def plan_read(status: Column, until: Column, leaving: Column, today: Column) -> Column:
    """(answer, card, steps, not_sure_returns, returns_on) of a stored answer: ``status`` done, skipped or snoozed, with or
    without a day ``until``; what fits neither counts as no answer."""
    again = F.date_sub(leaving, ASK_AGAIN)
    can_ask = today < F.date_sub(leaving, LAST_ASK)
    alone, day = until.isNull(), F.lit(None).cast("date")
    early = F.coalesce((status == "snoozed") & until.isNotNull(), F.lit(False))
    back = F.least(until, again)
    answer = F.when(alone & (status == "done"), "yes").when(alone & (status == "skipped"), "no").when((alone & (status == "snoozed")) | early, "not-sure").otherwise("none")
    card = F.when(early & (today >= back) & can_ask, "again").when((answer == "none") & can_ask, "first")
    steps = F.coalesce(alone & status.isin("done", "snoozed"), F.lit(False))
    return F.struct(answer.alias("answer"), card.alias("card"), steps.alias("steps"), F.when(today < again, again).alias("not_sure_returns"), F.when(early & (today < back), back).otherwise(day).alias("returns_on"))


def plan_write(answer: Column, leaving: Column, today: Column) -> Column:
    """(status, until) that an answer of today stores."""
    again = F.date_sub(leaving, ASK_AGAIN)
    early = (answer == "not-sure") & (today < again)
    return F.struct(F.when(answer == "yes", "done").when(answer == "no", "skipped").when(~early, "snoozed").alias("status"), F.when(early, again).alias("until"))


# ---- served files. Fixed values --------------------------------------------------------------------------------------

LARGEST_FILE = 25 * 1024 * 1024


def served_fault(derived: Column, text_same: Column, size: Column) -> Column:
    """Why a file can't be served: no_derivation, text_moved or over_cap; null if it can."""
    return F.when(~F.coalesce(derived, F.lit(False)), "no_derivation").when(~F.coalesce(text_same, F.lit(False)), "text_moved").when(size > LARGEST_FILE, "over_cap")


def record_fault(record: Column, content: Column, version: Column) -> Column:
    """Why the record (capture_hash, derivation_version, kept_per_page: map of page to number, darkened_pages, removed, quality,
    max_pixels) of a derived file can't stand: no_record, stale, version or bad_record; null if it can."""
    kept, dark = record["kept_per_page"], record["darkened_pages"]
    pages = F.forall(F.map_keys(kept), lambda k: k.rlike("^[1-9][0-9]*$")) & F.forall(F.map_values(kept), lambda v: v > 0)
    rising = F.forall(F.zip_with(dark, F.slice(dark, 2, F.greatest(F.size(dark), F.lit(1))), lambda a, b: b.isNull() | (a < b)), lambda x: x)
    fine = pages & F.forall(dark, lambda p: p >= 1) & rising & (record["removed"] >= 0) & record["quality"].between(0, 100) & (record["max_pixels"] > 0)
    return (
        F.when(record.isNull(), "no_record")
        .when(~record["capture_hash"].eqNullSafe(content), "stale")
        .when(~record["derivation_version"].eqNullSafe(version), "version")
        .when(~F.coalesce(fine, F.lit(False)), "bad_record")
    )


def opens_right_page(path: Column, published: Column, page: Column, pages: Column) -> Column:
    """Whether a citation opens the published file on a page that it has."""
    return F.coalesce((path == published) & (page >= 1) & (page <= pages), F.lit(False))


