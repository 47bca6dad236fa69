"""The keyword lexicon: counts by category, negation, labels and density."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The categories and their patterns. One pattern of "Decline/Destruction"
# stands twice and so counts twice; patterns with a capital I never match lower-cased text.
POSITIVE = {
    "Hope/Optimism": [
        r"\bhopeful?\b",
        r"\boptimistic\b",
        r"\bopportunity\w*\b",
        r"\bgrowth\b",
        r"\bprogress\b",
        r"\bimprov(e|ed|ement)\b",
        r"\binnovat(ive|ion|ions)\b",
        r"\bbetter\b",
        r"\bbright\b",
        r"\bpromising\b",
        r"\bprosper(ity|ous)\b",
        r"\bthrive\b",
        r"\bflourish(ing)?\b",
        r"\brenaissance\b",
    ],
    "Strength/Success": [
        r"\bstrong(er|est)?\b",
        r"\bstrength\b",
        r"\bresilien(t|ce)\b",
        r"\bhealthy?\b",
        r"\bsuccess(ful)?\b",
        r"\bproductivi(ty|e)\b",
        r"\bcreative\b",
        r"\binventi(ve|on)\b",
        r"\bwealthy?\b",
        r"\bbooming?\b",
        r"\bcompetitive(ness)?\b",
        r"\blead(er|ing)\b",
        r"\bexcellen(t|ce)\b",
        r"\bsuperior\b",
    ],
    "Stability/Order": [
        r"\bharmon(y|ious)\b",
        r"\bcooperat(e|ion|ive)\b",
        r"\bunit(y|ied)\b",
        r"\bpeace(ful)?\b",
        r"\balliance\b",
        r"\bpartnership\b",
        r"\bdisciplin(e|ed)\b",
        r"\bcompetent\b",
    ],
}
NEGATIVE = {
    "Fear/Anxiety": [
        r"\bfear\b",
        r"\bafraid\b",
        r"\bscared\b",
        r"\bworried?\b",
        r"\bworry(ing)?\b",
        r"\bpanic\b",
        r"\bcrisis|cr(ises|isis)\b",
        r"\bcollapse[ds]?\b",
        r"\bdark\b",
        r"\bterrible\b",
        r"\bthreat(en(ing|s)?)?\b",
        r"\bscary\b",
        r"\banxious\b",
        r"\banxiety\b",
        r"\bunsettl(ing|ed)\b",
        r"\balarming\b",
        r"\bperil\b",
        r"\bdoom(ed)?\b",
        r"\bscare\b",
    ],
    "Anger/Conflict": [
        r"\bangry\b",
        r"\banger\b",
        r"\bfrustrat(ed|ing|ion)\b",
        r"\bconflict\b",
        r"\bfight(ing)?\b",
        r"\bwar(s)?\b",
        r"\bviolen(t|ce)\b",
        r"\bhostile\b",
        r"\brage\b",
        r"\benemy\b",
        r"\bclash(es)?\b",
        r"\bcontrovers(y|ial)\b",
        r"\bdisput(e|es|ing)\b",
        r"\bconfront(ation|ing)?\b",
        r"\bresen(t|tment)\b",
        r"\bhatred?\b",
    ],
    "Decline/Destruction": [
        r"\bbad(ly)?\b",
        r"\bworse\b",
        r"\bworst\b",
        r"\bdecline[ds]?\b",
        r"\bdeclining\b",
        r"\bloss\b",
        r"\blost\b",
        r"\bdestruct(ive|ion)\b",
        r"\bdamage[ds]?\b",
        r"\bsuffer(ing)?\b",
        r"\bdifficult\b",
        r"\bpain(ful)?\b",
        r"\bproblem(s|atic)?\b",
        r"\btrouble\b",
        r"\bweak(ness|en(ed)?)?\b",
        r"\bdecay\b",
        r"\bdeteriorat(e|ion|ing)\b",
        r"\bnegative\b",
        r"\bdownside\b",
        r"\bbroke\b",
        r"\bbroken\b",
        r"\bstruggl(e|ing|es)\b",
        r"\bworsen(ing|s)?\b",
        r"\bdeteriorat(e|ion|ing)\b",
        r"\bsurrendering?\b",
        r"\bdepreciat(e|ion|ing)\b",
        r"\bimpoverish(ed|ment)?\b",
        r"\berod(e|ing|ion)\b",
        r"\bshambles?\b",
        r"\bmeltdowns?\b",
        r"\bdownturns?\b",
        r"\brecession\b",
        r"\bdepression\b",
        r"\bstagflat(e|ion)\b",
        r"\bdefault[ds]?\b",
        r"\binsolven(t|cy)\b",
        r"\bbankrupt(cy)?\b",
    ],
    "Crisis/Urgency": [
        r"\bdesperate\b",
        r"\bcritical\b",
        r"\bemergency\b",
        r"\bcatastroph(e|ic)\b",
        r"\bdisaster(s)?\b",
        r"\binevitable\b",
        r"\bvulnerable\b",
        r"\bvulnerability\b",
        r"\bsqueeze[ds]?\b",
        r"\bunsustainable\b",
        r"\bdanger(ous)?\b",
        r"\bgrave\b",
        r"\bsevere\b",
        r"\bunprecedented\b",
    ],
    "Financial/Political Risk": [
        r"\bimbalance[ds]?\b",
        r"\brisk(ing|ed|s)?\b",
        r"\bdebt(s)?\b",
        r"\bdeficit\b",
        r"\bborrow(ing|ed)?\b",
        r"\binflation(ary)?\b",
        r"\bhyperinflation\b",
        r"\bprint(ing)?\s+money\b",
        r"\bcivil\s+war\b",
        r"\brevolut(ion|ions|ionary)\b",
        r"\bregime\s+change\b",
        r"\bcoup[ds]?\b",
        r"\boverthrow\b",
        r"\bcyber\s?(war|attack)\b",
        r"\bsanction[ds]?\b",
        r"\btariff[ds]?\b",
        r"\bprotectionis(m|t)\b",
        r"\bde(-)?globalization\b",
        r"\bfragmentation\b",
    ],
}
MODALITY = {
    "Emphatic/Certain": [
        r"\balways\b",
        r"\bcertain(ly)?\b",
        r"\bdefinite(ly)?\b",
        r"\babsolutely\b",
        r"\bobvious(ly)?\b",
        r"\bclear(ly)?\b",
        r"\bundoubtedly\b",
        r"\bsurely\b",
        r"\bindeed\b",
        r"\bfirm(ly)?\b",
        r"\bstrongly\b",
        r"\bprofoundly\b",
        r"\bnever\b",
        r"\beveryone\b",
        r"\beverything\b",
        r"\bof\s+course\b",
        r"\bwithout\s+question\b",
        r"\bno\s+doubt\b",
        r"\bbeyond\s+(any\s+)?doubt\b",
        r"\bfor\s+sure\b",
        r"\bthere\'?s\s+no\s+question\b",
        r"\byou\s+can\s+see\b",
        r"\byou\s+will\s+see\b",
        r"\bthat\s+is\s+what\s+(always|invariably)\b",
        r"\bit\s+is\s+(always|invariably|inevitably)\b",
        r"\bevery\b",
        r"\ball\b",
        r"\bentire\b",
        r"\btotal\b",
        r"\bwhole\b",
    ],
    "Hedging/Doubt": [
        r"\buncertain(ty)?\b",
        r"\bunclear\b",
        r"\bunknown\b",
        r"\bdoubt\b",
        r"\bmaybe\b",
        r"\bperhap(s)?\b",
        r"\bpossibly\b",
        r"\bprobably\b",
        r"\bambiguous\b",
        r"\bconfus(ing|ion)\b",
        r"\bcomplex\b",
        r"\bcomplicated\b",
        r"\brough(ly)?\b",
        r"\bguess\b",
        r"\btend(s|ed)?\b",
        r"\buncertainly\b",
        r"\bseem(s|ed)?\b",
        r"\bappear(s|ed)?\b",
        r"\bsomewhat\b",
        r"\bpartial(ly)?\b",
        r"\bI\s+think\b",
        r"\bI\s+believe\b",
        r"\bI\s+would\s+say\b",
        r"\bdepend(s|ing)?\b",
        r"\bnot\s+(necessarily|exactly|entirely)\b",
    ],
    "Intensity Boosters": [
        r"\bvery\b",
        r"\bextremely\b",
        r"\bdeeply\b",
        r"\benormous\b",
        r"\bmassive(ly)?\b",
        r"\bhuge\b",
        r"\bsevere\b",
        r"\bdramatic\b",
        r"\bprofound\b",
        r"\bextraordinary\b",
        r"\btremendous\b",
        r"\bintense\b",
        r"\bradical(ly)?\b",
        r"\btotally\b",
        r"\bcompletely\b",
        r"\bentirely\b",
        r"\bimmense(ly)?\b",
        r"\bgigantic\b",
        r"\bcolossal\b",
        r"\bdevastating\b",
        r"\bshattering\b",
        r"\boverwhelming\b",
        r"\bstaggering\b",
        r"\bunbelievable?\b",
    ],
}
NEGATIONS = [r"\bnot\s+(\w+)", r"\bno\s+(\w+)", r"\bnever\s+(\w+)", r"\blos(?:e|ing|t)\s+(\w+)", r"\bwithout\s+(\w+)", r"\bhardly\s+(\w+)", r"\bbarely\s+(\w+)", r"\black\s+of\s+(\w+)", r"\babsence\s+of\s+(\w+)"]
NEGATABLE = [
    "strong",
    "strength",
    "growth",
    "progress",
    "stable",
    "stability",
    "healthy",
    "resilient",
    "thriving",
    "successful",
    "competitive",
    "advantage",
    "prosperity",
    "wealthy",
    "promising",
    "innovative",
    "productive",
    "creative",
    "excellent",
]
NEGATED_INTO = "Decline/Destruction"
NORM_CHARS = 30000

CATEGORIES: dict[str, list[str]] = {c: p for part in (POSITIVE, NEGATIVE, MODALITY) for c, p in part.items()}


def negated_categories() -> dict[str, list[str]]:
    """The negatable words that a positive pattern matches as a whole, by category, once for each such pattern."""
    return {c: [w for w in NEGATABLE for p in POSITIVE[c] if re.fullmatch(p, w)] for c in POSITIVE}


def column_name(category: str) -> str:
    return re.sub(r"[^a-z]+", "_", category.lower()).strip("_")


def _any_of(patterns: list[str]) -> str:
    """One pattern that holds wherever one of these does; the word boundary that most begin with is tested once."""
    plain = [p[2:] for p in patterns if p.startswith(r"\b") and "|" not in re.sub(r"\([^()]*(\([^()]*\)[^()]*)*\)", "", p)]
    rest = [p for p in patterns if p[2:] not in plain]
    by_letter: dict[str, list[str]] = {}  # so that a word is tried against the patterns of its first letter alone
    for p in dict.fromkeys(plain):
        by_letter.setdefault(p[0] if p[0].isalpha() and p[1:2] not in ("?", "*", "+", "{") else "", []).append(p)
    grouped = [c + "(?:" + "|".join(p[len(c) :] for p in ps) + ")" for c, ps in by_letter.items()]
    return "|".join([r"\b(?:" + "|".join(grouped) + ")", *rest])


def any_hit(text: Column) -> Column:
    """Whether a text has a match of any pattern: false for most sentences, and then all counts are 0."""
    return F.regexp_like(text, F.lit(_any_of([p for ps in CATEGORIES.values() for p in ps])))


def _word_forms(pattern: str) -> set[str] | None:
    """The words that a pattern of one whole word matches (`*` at the end of a form: any word that begins so); None for other patterns."""
    if not (pattern.startswith(r"\b") and pattern.endswith(r"\b")):
        return None
    body = pattern[2:-2]
    if not re.fullmatch(r"(?:[a-z]|\[[a-z]+\]|\(|\)|\||\?|\\w\*$)+", body):
        return None

    def several(x: str) -> tuple[set[str], str]:
        """Forms of alternatives up to a closing parenthesis or the end, and the rest."""
        out, forms = set(), {""}
        while x and x[0] != ")":
            if x[0] == "|":
                out, forms, x = out | forms, {""}, x[1:]
                continue
            if x.startswith(r"\w*"):
                part, x = {"*"}, x[3:]
            elif x[0] == "(":
                part, x = several(x[1:])
                x = x[1:]
            elif x[0] == "[":
                part, x = set(x[1 : x.index("]")]), x[x.index("]") + 1 :]
            else:
                part, x = {x[0]}, x[1:]
            if x.startswith("?"):
                part, x = part | {""}, x[1:]
            forms = {f + g for f in forms for g in part}
        return out | forms, x

    depth = 0
    for c in body:  # alternatives of the whole pattern have boundaries on one side alone
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            return None
    return several(body)[0]


def _share_a_word(a: set[str], b: set[str]) -> bool:
    return any(x == y or x[-1:] == "*" and y.startswith(x[:-1]) or y[-1:] == "*" and x.startswith(y[:-1]) for x in a for y in b)


def counted_together(patterns: list[str]) -> list[list[str]]:
    """The patterns in groups of which no word matches two, so that one search counts a group; patterns that aren't of one word stand alone."""
    groups: list[tuple[list[str], set[str]]] = []
    alone = []
    for p in patterns:
        forms = _word_forms(p)
        if forms is None:
            alone.append([p])
            continue
        home = next((g for g in groups if not _share_a_word(g[1], forms)), None)
        if home is None:
            groups.append(([p], forms))
        else:
            home[0].append(p)
            home[1].update(forms)
    return [g for g, _ in groups] + alone


def raw_count(text: Column, category: str) -> Column:
    """Matches of all patterns; texts without any match cost one search for the whole category."""
    patterns = CATEGORIES[category]
    total = F.lit(0)
    for group in counted_together(patterns):
        total = total + F.regexp_count(text, F.lit(group[0] if len(group) == 1 else _any_of(group)))
    return F.when(F.regexp_like(text, F.lit(_any_of(patterns))), total).otherwise(F.lit(0))


def negated_words(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit("(?i)" + "|".join(NEGATIONS))), F.flatten(F.array(*(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)) for p in NEGATIONS)))).otherwise(F.array().cast("array<string>"))


def _among(found: Column, wanted: list[str]) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(wanted))) if wanted else F.lit(0)


def counts(text: Column, hit: Column | None = None) -> dict[str, Column]:
    """Counts by category of cleaned text, after negation: a negated positive word leaves its category (down to 0) and counts as decline.

    hit is a materialised column of any_hit, so that texts without a match cost one search.
    """
    hit = any_hit(text) if hit is None else hit
    negated, map_ = negated_words(text), negated_categories()
    hits = {c: _among(negated, ws) for c, ws in map_.items()}
    out = {}
    for c in CATEGORIES:
        n = raw_count(text, c)
        if c in hits:
            n = F.greatest(F.lit(0), n - hits[c])
        if c == NEGATED_INTO:
            for h in hits.values():
                n = n + h
        out[column_name(c)] = F.when(hit, n).otherwise(F.lit(0))
    return out


def total(part: dict[str, list[str]]) -> Column:
    """Sum of the count columns of a section."""
    out = F.lit(0)
    for c in part:
        out = out + F.col(column_name(c))
    return out


def valence() -> Column:
    pos, neg = total(POSITIVE), total(NEGATIVE)
    return F.when(pos > neg, "positive").when(neg > 0, "negative").otherwise("neutral")


def certainty() -> Column:
    emph, hedge = F.col(column_name("Emphatic/Certain")), F.col(column_name("Hedging/Doubt"))
    return F.when(emph > hedge, "high").when(hedge > 0, "low").otherwise("medium")


def modality(certainty_: Column) -> Column:
    """The label of the other axis that a certainty stands for."""
    return F.when(certainty_ == "high", "emphatic").when(certainty_ == "low", "hedged").otherwise("neutral")


def density(count: Column, chars: Column) -> Column:
    """Count for each NORM_CHARS characters."""
    return count / (chars / F.lit(float(NORM_CHARS)))
