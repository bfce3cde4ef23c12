"""Word lists and patterns of the exact checks."""

from inkloom.functions.text import SPACE as _S

# Glyphs that plain typing doesn't make.
DECORATIVE = "[‘’“”→←⇒⇨➡]"

# Small words that don't count in a title.
MINOR_WORDS = ("a", "an", "the", "and", "or", "but", "for", "nor", "of", "to", "in", "on", "at", "by", "vs", "via", "with", "as", "is")

# Edit notes left in a text.
CHANGE = "(?:added|removed|dropped|updated|revised|edited|expanded|extended|amended|corrected)"
REVISION_NOTE = (
    r"(?im)[(\[]\s*\+\s*\d+[^)\]]*?\b" + CHANGE + r"\b[^)\]]*[)\]]"
    r"|[(\[]\s*" + CHANGE + r"\s+(?:to|per|with|after|following|based\s+on|for)\b[^)\]]*[)\]]"
    r"|[(\[]\s*now\s+(?:includes|shows|reflects|covers)\b[^)\]]*[)\]]"
    r"|\b(?:per|as\s+per)\s+(?:your|the)\s+(?:feedback|request|comments?)\b"
    r"|\bas\s+(?:you\s+)?requested\b|\bat\s+your\s+request\b"
    r"|^\s*" + CHANGE + r"\s*:\s*(?:added|removed|dropped|now|to|per|as)\b"
)

# Numbered parts.
PART = r"(?i)\b(steps?|parts?|chapters?|phases?|stages?|modules?|lessons?|weeks?|days?)\s+(\d{1,3})\b(?:\s*(?:–|—|-|to|and|&)\s*(\d{1,3})\b)?"

# Contrast frames and closing cues.
CONTRAST = r"(?i)\b(?:instead of|rather than|not (?:only|just) [^.;]{1,60}?,? but|not [^.;,]{1,40}, but)\b"
CLOSER = r"(?i)^(?:so|both|each|every)\b|\b(?:which|that|this) is why\b"

# Headings.
NUMBERED = r"(?i)^\s*(?:step\s+)?\d+(?:\.\d+)*[.):]?\s+\S"
EMOJI = r"^\s*[☀-➿\x{1F300}-\x{1FAFF}⭐⬆✅]"
VERSION = r"(?i)^[^\p{L}\p{N}_]*v?(\d+(?:\.\d+){1,3})[^\p{L}\p{N}_]*(?:[-–—:|]\s*(.+?))?\s*$"
CHANGE_GROUPS = ("added", "changed", "deprecated", "removed", "fixed", "security")

# The words of the flat-certainty register.
REGISTER = tuple(
    """
    admits alone argued armed arms asserted asserts asymmetry backstop bit-identical bites byte-for-byte byte-identical carried carries carrying carve-out ceiling
    cheap chokepoint cited cites contradicted contradicting decides declines defect defects degrades deliberate deliberately died disagree disagreed disagreement
    drains drifted eleven empirically escalates ever faithful falsified filed folded folds forever genuine genuinely half halves handed held holds honest honestly
    honoured indistinguishable inert judged landed lands legitimately lever load-bearing loses loud loudly machinery mattered measured merely minted mints
    mutation-checked mutation-tested mutation-verified never nine nobody nothing nowhere obligation opposite outright owed parked plainly pre-fix precedent
    precisely predates premise probed provably proven proves quietly re-derived re-derives re-measured re-read re-verified reaches reaped reds refusal refusals
    refused refuses refusing refuted remedy reproduces restated rests retires rides ruling rung says seam self-heals settles short-circuits sitting spellings stamped
    stamps standing stranded structurally survived survives surviving sweep symptom thirteen throwaway told ungated unguarded vacuous vacuously walked wedge wedged
    whoever whose worse
    """.split()
)
REGISTER_WORD = "[a-z0-9/_-]*[a-z][a-z0-9/_-]*"
ECHO_WORD = "[a-z0-9’'-]+"

# Hyphenated compounds after a linking verb, and those that keep the hyphen.
LINKING = "(?:is|are|was|were|be|been|being|seems?|seemed|feels?|felt|looks?|looked|became|becomes?|remains?|remained|stays?|stayed)"
PREDICATE_HYPHEN = r"(?im)\b" + LINKING + r"\s+(?:(?:very|more|less|fully|mostly|entirely|highly|still|now|not)\s+)?([a-z]+(?:-[a-z]+)+)(?=\s*(?:[.,;:!?)]|$|\s+(?:and|or|but|because|when|if|so)\b))"
KEEPS_HYPHEN = (
    r"(?i)^(?:self|ex|all|non|anti|pre|post|re|co|semi|quasi|pseudo|multi|sub|mid)-"
    r"|-(?:based|safe|free|wide|like|proof|sensitive|insensitive|aware|specific|friendly|only|to-date)$"
    r"|^(?:read-only|write-only|built-in|opt-in|opt-out|so-called|up-to-date|out-of-date|one-off|follow-up|set-up|log-in|sign-in|check-in|add-on|plug-in|drop-in|in-house|on-premises|x-ray|e-mail|t-shirt)$"
)

# Claims that an edit must keep.
FENCED = r"(?ms)^```.*?^```"
CODE_SPAN = r"(?is)`[^`\n]+`|<code>.*?</code>"
URL = r"https?://[^\s)\"'<>\]]+"
NUMBER = r"(?<![\p{L}\p{N}_.])[+−-]?\d[\d,]*(?:\.\d+)?%?(?![\p{L}\p{N}_])"
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
SUPERLATIVE = (
    r"(?i)\bthe\s+(?:single\s+|very\s+)?(?:most|least|best|worst|first|last|only|largest|smallest|highest|lowest|fastest|slowest|[a-z]{3,}est)\b"
    r"|\bmost\s+likely\s+to\b|\bby\s+far\b|\bof\s+(?:all|any)\b|\bthe\s+\w+(?:\s+(?:that|which|who))?\s+(?:most|least)\s+\w+"
)
SCOPE = r"(?i)\b(?:all|every|each|none|no|any|both|either|neither|only|solely|exclusively|always|never|entirely|wholly|simultaneously|at\s+once|per|across)\b"
HEDGE = r"(?i)\b(?:roughly|approximately|about|around|nearly|almost|mostly|largely|generally|typically|usually|often|sometimes|may|might|could|would|likely|probably|apparently|seems?|appears?|estimated?)\b"
NEGATION = r"(?i)\b(?:not|never|without|cannot|lacks?|absent|fails?\s+to)\b|n't\b"
CAPITALIZED = r"\b[A-Z][A-Za-z0-9]*(?:[-.][A-Za-z0-9]+)*\b"
NOT_NAMES = tuple("A An The I If In On At To Of For And But Or So It This That These Those We You They He She There Here When Where What Why How Not No Its His Her Their Our My Your".split())
QUOTED = r"[\"“]([^\"”\n]{3,120})[\"”]"
NOTES = {
    "number": "a number of the source is missing in the rewrite",
    "name": "a name of the source is missing in the rewrite",
    "quoted": "quoted words changed",
    "verbatim": "code, a fenced block or a link target changed",
    "superlative": "a ranking was lost",
    "scope": "a word of scope was lost",
    "negation": "a negation was lost",
    "hedge": "a hedge was lost",
}

__all__ = [n for n in dir() if n.isupper()]
