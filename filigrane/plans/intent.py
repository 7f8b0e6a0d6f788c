"""Planning of requests: from words or a parsed document to a structured query. Plain Python, no data is touched."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame

from filigrane.functions.text import fold_text
from filigrane.operators.search import StructuredQuery, Term
from filigrane.operators.views import CatalogFilter, auto_open

# Words that say nothing about names.
STOP_WORDS = frozenset(
    "the a an and or but for to of in on at with show me my all please find search files file folder open look see ve veya ile "
    "için tüm bütün bana bul ara göster dosya dosyaları klasör aç lütfen bu ait dair nin nın nun nün".split()
)
# Words about time, which bind dates and not names.
TIME_WORDS = frozenset(
    "bugün dün yarın geçen önceki son hafta haftaki haftanın ay ayı ayına ayındaki yaz yaza yazın yazdaki kış kışın ilkbahar "
    "ilkbaharda sonbahar sonbaharda dönem dönemi dönemine döneminde dönemindeki".split()
)
# Words that name a kind of file.
KIND_WORDS = frozenset("pdf excel image picture photo fotoğraf resim video film audio music müzik document belge doküman".split())
# What tells a type in a text, and its extensions.
TYPE_WORDS = {
    "video": ("video film movie clip mp4 avi mkv mov wmv", ".mp4 .avi .mkv .mov .wmv .flv .m4v .3gp"),
    "image": ("image picture photo fotoğraf resim jpg jpeg png gif bmp", ".jpg .jpeg .png .gif .bmp .tiff .svg .webp"),
    "document": ("document belge doküman doc pdf text txt docx rtf odt", ".pdf .doc .docx .txt .rtf .odt .xls .xlsx .ppt .pptx"),
    "audio": ("audio music müzik şarkı song sound mp3 wav flac ogg", ".mp3 .wav .flac .ogg .aac .wma .m4a"),
    "code": ("code kod source script cs js py cpp java html", ".cs .js .py .cpp .java .html .css .xml .json .sql"),
    "subtitle": ("subtitle altyazı sub srt vtt ass", ".srt .vtt .ass .sub"),
}
# Turkish plural endings, the longest first.
PLURALS = ("larımız", "lerimiz", "larınız", "leriniz", "larım", "lerim", "ların", "lerin", "ları", "leri", "lar", "ler")
# Verbs that ask to open the result.
OPEN_VERBS = frozenset("aç açın açınız open launch başlat çalıştır".split())
WORD = re.compile(r"[^\W_]+")
DATE = re.compile(r"\d{4}-\d{2}-\d{2}")

#: Weight of the first and lowest weight of each kind of keyword, and the step from one to the next.
WEIGHTS = {"primary": (1.0, 1.0, 0.0), "variant": (0.9, 0.75, 0.05), "translation": (0.8, 0.65, 0.05), "phrase": (0.75, 0.6, 0.05), "context": (0.35, 0.2, 0.05)}


def decayed(kind: str, position: int) -> float:
    first, least, step = WEIGHTS[kind]
    return max(least, first - step * position)


def keywords(text: str, most: int = 8) -> list[str]:
    out = []
    for w in WORD.findall(text.lower()):
        if len(w) > 1 and w not in STOP_WORDS and w not in out:
            out.append(w)
    return out[:most]


def strip_plural(word: str) -> str:
    for end in PLURALS:
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def wants_open(text: str) -> bool:
    return not OPEN_VERBS.isdisjoint(WORD.findall(text.lower()))


def by_rules(text: str) -> StructuredQuery:
    """Keywords in one group, so any of them will do; types by the names that occur in the text."""
    words = keywords(text)
    terms = tuple(Term(w, max(0.7, 1 - 0.05 * i)) for i, w in enumerate(words))
    hard = [e for marks, extensions in TYPE_WORDS.values() if any(m in text.lower() for m in marks.split()) for e in extensions.split()]
    return StructuredQuery(terms=terms, hard_extensions=tuple(dict.fromkeys(hard)))


def fallback(text: str, has_dates: bool = False, has_types: bool = False, most: int = 4) -> StructuredQuery:
    """Few words, each a group of its own, so all must match; without words of time or kind where a filter says it."""
    words = [strip_plural(w) for w in keywords(text) if not (has_dates and w in TIME_WORDS)]
    words = list(dict.fromkeys(w for w in words if not (has_types and w in KIND_WORDS)))[:most] or [text]
    return StructuredQuery(terms=tuple(Term(w, max(0.7, 1 - 0.05 * i), i) for i, w in enumerate(words)))


def valid_date(text: str | None) -> str | None:
    """A day of the calendar as it is; anything else does not bind."""
    if not text or not DATE.fullmatch(text):
        return None
    try:
        date.fromisoformat(text)
    except ValueError:
        return None
    return text


FIELDS = frozenset({"mode", "target", "hard_extensions", "soft_extensions", "folders", "created_from", "created_to_exclusive", "modified_from", "modified_to_exclusive", "min_mb", "max_mb", "open"})
TARGETS = {"any": (0.5, 0.5), "file": (1.0, 0.0), "folder": (0.0, 1.0)}


def checked_intent(intent: dict) -> dict:
    """The document if all its fields are known and of their kind; else ValueError."""
    if unknown := set(intent) - FIELDS:
        raise ValueError(f"not an intent document: {sorted(unknown)}")
    for name in ("hard_extensions", "soft_extensions", "folders"):
        if not isinstance(intent.get(name, []), list) or not all(isinstance(x, str) for x in intent.get(name, [])):
            raise ValueError(f"{name} must be a list of texts")
    if intent.get("mode", "search") not in ("search", "filter", "keyword") or intent.get("target", "any") not in TARGETS:
        raise ValueError("unknown mode or target")
    for name in ("min_mb", "max_mb"):
        if intent.get(name) is not None and (isinstance(intent[name], bool) or not isinstance(intent[name], (int, float)) or intent[name] < 0):
            raise ValueError(f"{name} must be a size")
    return intent


def weighted_terms(words: dict) -> list[Term]:
    """Anchors (a group each), phrases and context with weights that fall with the position. Of equal texts the one with
    the first role counts, then that with the largest weight; terms come by role, group and weight."""
    found: list[tuple[int, Term]] = []
    for g, anchor in enumerate(words.get("anchors", [])):
        found.append((0, Term(anchor["primary"], decayed("primary", 0), g, "exact")))
        found += [(0, Term(v, decayed("variant", i), g, "variant")) for i, v in enumerate(anchor.get("variants", []))]
        found += [(0, Term(v, decayed("translation", i), g, "variant")) for i, v in enumerate(anchor.get("translations", []))]
    found += [(1, Term(p, decayed("phrase", i), -1, "phrase")) for i, p in enumerate(words.get("phrases", []))]
    found += [(2, Term(c, decayed("context", i), -1, "context")) for i, c in enumerate(words.get("context", []))]
    best: dict[str, tuple[int, Term]] = {}
    for role, t in found:
        held = best.get(t.text.lower())
        if held is None or (role, -t.weight) < (held[0], -held[1].weight):
            best[t.text.lower()] = (role, t)
    return [t for role, t in sorted(best.values(), key=lambda x: (x[0], x[1].group, -x[1].weight))]


def says_more(intent: dict, words: dict) -> bool:
    """Whether an anchor names more than a kind, an extension or a folder that the filters hold already."""
    told = {e.lower().lstrip(".") for name in ("hard_extensions", "soft_extensions") for e in intent.get(name, [])}
    told |= {f.lower() for f in intent.get("folders", [])} | KIND_WORDS
    primaries = [strip_plural((a.get("primary") or "").strip().lower()) for a in words.get("anchors", [])]
    return any(p and p not in told for p in primaries)


def from_documents(intent: dict, words: dict, text: str = "") -> StructuredQuery:
    """The intent (mode, target, extensions, folders, bounds) and the keywords (anchors, phrases, context). The mode
    `filter` holds unless an anchor says more than the filters; it takes no keywords. Anchors that name a hinted folder
    move to the folder context. The best result is to be opened if the intent says so and the text has a verb for it."""
    checked_intent(intent)
    filter_only = intent.get("mode") == "filter" and not says_more(intent, words)
    terms = [] if filter_only else weighted_terms(words)
    hard = tuple(e.lower() for e in intent.get("hard_extensions", []))
    bounds = {k: valid_date(intent.get(k)) for k in ("created_from", "created_to_exclusive", "modified_from", "modified_to_exclusive")}
    for low, high in (("created_from", "created_to_exclusive"), ("modified_from", "modified_to_exclusive")):
        if bounds[low] and bounds[high] and bounds[low] >= bounds[high]:
            raise ValueError("the first date must be before the last")
    catalog = CatalogFilter(
        created_from=bounds["created_from"], created_before=bounds["created_to_exclusive"], modified_from=bounds["modified_from"], modified_before=bounds["modified_to_exclusive"],
        min_mb=intent.get("min_mb"), max_mb=intent.get("max_mb"),
    )
    files, folders = TARGETS[intent.get("target", "any")]
    told = {e.lower().lstrip(".") for e in hard}
    query = StructuredQuery(
        terms=tuple(t for t in terms if t.kind != "context"),
        context=tuple(t for t in terms if t.kind == "context"),
        folder_hints=tuple((f, 1.0) for f in intent.get("folders", [])),
        soft_extensions=tuple(e for e in intent.get("soft_extensions", []) if e.lower().lstrip(".") not in told),
        hard_extensions=hard,
        predicted_extensions=hard,
        file_weight=files,
        folder_weight=folders,
        catalog=catalog,
        filter_only=filter_only,
        should_open=intent.get("open") is True and wants_open(text),
    )
    return folders_out_of_terms(query)


def folders_out_of_terms(query: StructuredQuery) -> StructuredQuery:
    """Where files are asked for, anchor groups that name a hinted folder tell where to look: they move from the terms to
    the folder context, which filters. Nothing moves if no other anchor would be left."""
    if not query.wants_files or not query.folder_hints:
        return query
    hints = {fold_text(h.lower()).lower() for h, _ in query.folder_hints}
    named = {t.group for t in query.terms if t.anchors and fold_text(t.text.lower()).lower() in hints}
    moved = tuple(t for t in query.terms if t.anchors and t.group in named)
    left = tuple(t for t in query.terms if t not in moved)
    if not moved or not any(t.anchors for t in left):
        return query
    return replace(query, terms=left, folder_context=moved)


@dataclass(frozen=True)
class Outcome:
    """What a request came to: its rows, how they were found, why not as asked, what to open and the plan."""

    results: DataFrame
    mode: str  # standard, offline, advanced, rules
    used_fallback: bool = False
    reason: str | None = None
    open_path: DataFrame | None = None
    query: StructuredQuery | None = None


def serve(
    text: str, *, natural: bool, online: bool, standard: Callable[[str], DataFrame], advanced: Callable[[StructuredQuery], DataFrame], parse: Callable[[str], StructuredQuery]
) -> Outcome:
    """Plain requests and those without a connection go to the standard search. Others are parsed, by rules if the parser
    fails; where the token index is not ready (`LookupError`) the standard search answers."""
    if not natural:
        return Outcome(standard(text), "standard")
    if not online:
        return Outcome(standard(text), "offline", True, "no connection")
    mode = "advanced"
    try:
        query = parse(text)
    except Exception as error:  # whatever the parser cannot do, the rules answer, and the reason is kept
        mode, query = "rules", replace(by_rules(text), fallback_reason=str(error))
    try:
        found = advanced(query)
    except LookupError as error:
        return Outcome(standard(text), "standard", True, str(error))
    return Outcome(found, mode, mode == "rules", query.fallback_reason, auto_open(found) if query.should_open else None, query)


def refresh(before: Outcome, text: str, *, standard: Callable[[str], DataFrame], advanced: Callable[[StructuredQuery], DataFrame]) -> Outcome:
    """The same request again: a stored plan is not parsed anew, and nothing is opened."""
    return replace(before, results=advanced(before.query) if before.query else standard(text), open_path=None)
