"""Scored search: the standard one over tokens and the structured one over anchor groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.functions.kinds import folder_synonyms, type_extensions
from filigrane.functions.text import extension, fold_native, fold_text, near, stem, tokenize_ascii
from filigrane.operators.views import CatalogFilter, has_segment

TRAILING_MIN, TRAILING_WEIGHT = 2, 0.7


def standard_search(items: DataFrame, tokens: list[str], query: str, *, limit: int = 50, name_tokens: Callable[[Column], Column] = tokenize_ascii, id_col: str = "item_id") -> DataFrame:
    """Items that have a query token, or a token that contains the last one, with scores.

    50 for each matched token, 100 if they are as many as the query has (so never, if it repeats one), 200 if the name is
    the query, 25 for each matched token that is a token of the name; 2 for each time it was opened. Everything times 0.7
    if only the last token matched in part. Ties go by name, then by path. One pass over the items: the tokens of a query
    are few, so matching is a fixed expression per row without a shuffle.
    """
    n_tokens, last = len(tokens), tokens[-1] if tokens else ""
    tokens = list(dict.fromkeys(tokens))
    if not tokens or limit <= 0:
        return items.limit(0).withColumn("score", F.lit(0.0))
    own = name_tokens(F.col("name"))
    rows = items.withColumn("__own", own)
    wanted = F.array(*[F.lit(t) for t in tokens])
    hit = F.size(F.array_intersect(wanted, F.col("__own")))
    part = F.exists("__own", lambda t: F.contains(t, F.lit(last))) if len(last) >= TRAILING_MIN else F.lit(False)
    in_part = part & ~F.array_contains("__own", last)
    matched = hit + in_part.cast("int")
    score = (
        50.0 * matched
        + F.when(matched == n_tokens, 100.0).otherwise(0.0)
        + F.when(F.lower("name") == query.lower(), 200.0).otherwise(0.0)
        + 25.0 * hit
        + 2.0 * F.col("open_count")
    )
    score = score * F.when((hit == 0) & in_part, TRAILING_WEIGHT).otherwise(1.0)
    found = rows.where(matched > 0).withColumn("score", score).drop("__own")
    return found.orderBy(*relevance(), F.col(id_col)).limit(limit)


def relevance() -> list[Column]:
    """By score, then by name and path without regard to case, then by path."""
    return [F.col("score").desc(), F.lower("name"), F.lower("full_path"), F.col("full_path")]


def strategy_score(matched: Column, exact: Column, open_count: Column) -> Column:
    """A pluggable score of one matched token: 100 if it is the very one, else 25, and 2 for each time it was opened."""
    return F.when(matched, F.when(exact, 100.0).otherwise(25.0) + 2.0 * open_count).otherwise(0.0)


@dataclass(frozen=True)
class Term:
    """Anchors (plain, exact, variant) choose items, a group of them at a time; phrases and context only add to scores."""

    text: str
    weight: float = 1.0
    group: int = 0
    kind: str = "plain"  # plain, exact, variant, phrase, context

    @property
    def anchors(self) -> bool:
        return self.kind not in ("phrase", "context")


@dataclass(frozen=True)
class StructuredQuery:
    """What the planner makes of a request."""

    terms: tuple[Term, ...] = ()
    context: tuple[Term, ...] = ()
    folder_hints: tuple[tuple[str, float], ...] = ()
    soft_extensions: tuple[str, ...] = ()
    hard_extensions: tuple[str, ...] = ()
    file_weight: float = 0.5
    folder_weight: float = 0.5
    catalog: object = None
    filter_only: bool = False
    folder_context: tuple[Term, ...] = ()
    predicted_extensions: tuple[str, ...] = ()
    file_types: tuple[str, ...] = ()
    folder_contents: bool = True
    should_open: bool = False
    fallback_reason: str | None = None

    @property
    def without_terms(self) -> bool:
        return self.filter_only or not (self.terms or self.context)

    @property
    def wants_folders(self) -> bool:
        return self.folder_weight > self.file_weight

    @property
    def wants_files(self) -> bool:
        return self.file_weight > self.folder_weight

    @property
    def folders_preferred(self) -> bool:
        return self.folder_weight - self.file_weight > 0.3

    @property
    def files_preferred(self) -> bool:
        return self.file_weight - self.folder_weight > 0.3 and self.file_weight > 0.7

    @property
    def allowed_extensions(self) -> list[str]:
        """Hard ones before predicted ones before those of the types; none bind where folders are wanted."""
        if self.wants_folders:
            return []
        own = self.hard_extensions or self.predicted_extensions
        own = own or tuple(e for t in self.file_types for e in type_extensions(t))
        return list(dict.fromkeys("." + e.lower().lstrip(".") for e in own))


def contribution(own: Column, token: str, weight: float, none_else: Column) -> Column:
    """A token's worth for an item: whole, in part from 4 characters on (3 with a digit), near only where `none_else` says
    that the catalogue has no item with the token whole or in part."""
    whole, part = token_hits(own, token)
    close = F.exists(own, lambda t: near(t, F.lit(token), 2 if len(token) >= 7 else 1)) & none_else if len(token) >= 4 else F.lit(False)
    return F.when(whole, weight).when(part, 0.7 * weight).when(close, 0.4 * weight)


def token_hits(own: Column, token: str) -> tuple[Column, Column]:
    long_enough = len(token) >= 4 or len(token) >= 3 and any(c.isdigit() for c in token)
    return F.array_contains(own, token), F.exists(own, lambda t: F.contains(t, F.lit(token))) if long_enough else F.lit(False)


def gates(rows: DataFrame, own: Column, terms: tuple[Term, ...], tokens: Callable[[str], list[str]]) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with one column for each token that may match nearly: whether no row has it whole or in part. One
    aggregation of all rows to a single one."""
    asked = [x for t in terms if t.anchors for x in tokens(t.text) if len(x) >= 4]
    asked = list(dict.fromkeys(asked))
    if not asked:
        return rows, {}
    none = [(~F.coalesce(F.max(hit[0] | hit[1]), F.lit(False))).alias(f"__none{i}") for i, hit in enumerate(token_hits(own, x) for x in asked)]
    return rows.crossJoin(F.broadcast(rows.agg(*none))), {x: F.col(f"__none{i}") for i, x in enumerate(asked)}  # one row


def anchor_groups(own: Column, terms: tuple[Term, ...], tokens: Callable[[str], list[str]], none_else: dict[str, Column] | None = None) -> tuple[Column, dict[str, Column]]:
    """Whether every group has a term all of whose tokens match, and each token's best contribution. Spellings of a token
    that fold to the same are alternatives. Without an anchor nothing matches."""
    groups: dict[int, list[Column]] = {}
    best: dict[str, list[Column]] = {}
    none_else = none_else or {}
    for t in terms:
        if not t.anchors:
            continue
        parts = {x: contribution(own, x, t.weight, none_else.get(x, F.lit(True))) for x in dict.fromkeys(tokens(t.text))}
        if not parts:
            continue
        spellings: dict[str, list[Column]] = {}
        for x, c in parts.items():
            spellings.setdefault(fold_text(x), []).append(c.isNotNull())
        ok = reduce(Column.__and__, [reduce(Column.__or__, own_) for own_ in spellings.values()])
        groups.setdefault(t.group, []).append(ok)
        for x, c in parts.items():
            best.setdefault(x, []).append(F.when(ok, c))
    every = reduce(Column.__and__, [reduce(Column.__or__, oks) for oks in groups.values()]) if groups else F.lit(False)
    return every, {x: F.coalesce(F.greatest(*cs) if len(cs) > 1 else cs[0], F.lit(0.0)) for x, cs in best.items()}


def structured_search(items: DataFrame, query: StructuredQuery, *, tokens: Callable[[str], list[str]] = lambda t: t.lower().split(), limit: int = 100, name_tokens: Callable[[Column], Column] = tokenize_ascii, separator: str = "/", keys: list[Column] | None = None) -> DataFrame:
    """Items of which every anchor group has a match, scored by contributions, folder, type and phrase bonuses.
    Without terms, or in filter-only mode, all items that pass the filters. `keys`: the order, by relevance if not given.

    A matched directory is replaced by what lies below it, with its matches, where folders are not wanted and the items
    have `ancestors` (the paths above each); what comes out twice counts once, with the best of each match.
    """
    if query.without_terms:
        rows, best = filtered(items, query, separator), {}
    else:
        rows, best = matched_items(items, query, tokens, name_tokens, separator)
    parent = name_tokens(F.coalesce(F.substring_index(F.col("parent_path"), separator, -1), F.lit("")))
    own_stem = F.array_join(name_tokens(stem(F.col("name"))), " ")
    score = F.lit(0.0)
    for x, c in best.items():
        score = score + 100.0 * c + F.when(F.array_contains(parent, x), 60.0 * c).otherwise(0.0)
    for hint, weight in query.folder_hints:
        score = score + F.when(F.contains(F.lower("full_path"), F.lit(hint.lower())), 100.0 * min(1.0, max(0.0, weight))).otherwise(0.0)
    if query.wants_folders:
        score = score + F.when(F.col("is_dir"), 150.0 * query.folder_weight).otherwise(0.0)
    if query.wants_files:
        score = score + F.when(~F.col("is_dir"), 100.0 * query.file_weight).otherwise(0.0)
    if query.soft_extensions:
        soft = F.array(*[F.lit(e.lower().lstrip(".")) for e in query.soft_extensions])
        place = F.array_position(soft, F.substring(F.lower(extension(F.col("name"))), 2, 1 << 30))  # the first one, from 1
        score = score + F.when(~F.col("is_dir") & (place > 0), F.greatest(F.lit(10.0), 40.0 - 5.0 * place)).otherwise(0.0)
    for t in query.terms:
        if t.kind in ("phrase", "exact"):
            text = " ".join(tokens(t.text))
            inside = F.contains(own_stem, F.lit(text)) if len(text) > 1 else F.lit(False)
            score = score + F.when(own_stem == text, 150.0 * t.weight).when(inside, 75.0 * t.weight).otherwise(0.0)
    context: dict[str, float] = {}
    for t in query.context:
        for x in tokens(t.text):
            context[x] = max(context.get(x, 0.0), t.weight)
    for x, weight in context.items():
        score = score + F.when(F.array_contains(name_tokens(stem(F.col("name"))), x), 30.0 * weight).otherwise(0.0)
    score = score + 2.0 * F.col("open_count")
    out = rows.withColumn("score", score).select(*[c for c in rows.columns if not c.startswith("__")], "score")
    return out.orderBy(*(keys or relevance())).limit(max(0, limit))


def matched_items(items: DataFrame, query: StructuredQuery, tokens, name_tokens, separator: str) -> tuple[DataFrame, dict[str, Column]]:
    """Items that the anchors choose and the filters leave, and the columns of their tokens' contributions."""
    own = F.col("__own")
    rows, none_else = gates(items.withColumn("__own", name_tokens(F.col("name"))), own, query.terms, tokens)
    every, best = anchor_groups(own, query.terms, tokens, none_else)
    rows = rows.where(every)
    rows = rows.withColumns({f"__c{i}": c for i, c in enumerate(best.values())})
    values = {x: F.col(f"__c{i}") for i, x in enumerate(best)}
    rows = rows.select(*items.columns, *[f"__c{i}" for i in range(len(values))])
    if query.folders_preferred:
        rows = rows.where("is_dir")
    elif query.files_preferred:
        rows = rows.where("NOT is_dir")
    allowed = query.allowed_extensions
    typed = F.lower(extension(F.col("name"))).isin(allowed) if allowed else F.lit(True)
    expands = not query.wants_folders and query.folder_contents and "ancestors" in items.columns
    if expands:
        below = items.withColumn("__folder", F.explode("ancestors"))
        folders = rows.where("is_dir").select(F.col("full_path").alias("__folder"), *[F.col(f"__c{i}") for i in range(len(values))])
        below = below.join(folders, "__folder").drop("__folder").where((~F.col("is_dir") & typed) if allowed else F.lit(True))
        rows = rows.where(~F.col("is_dir") & typed).unionByName(below)
        merged = [F.max(f"__c{i}").alias(f"__c{i}") for i in range(len(values))]
        rest = [F.first(c).alias(c) for c in items.columns if c != "full_path"]
        rows = rows.groupBy(F.lower("full_path").alias("__path")).agg(F.min("full_path").alias("full_path"), *rest, *merged).select(*items.columns, *[f"__c{i}" for i in range(len(values))])
    elif not query.wants_folders:
        rows = rows.where(F.col("is_dir") | typed) if query.folder_contents and allowed else rows.where(typed)
    if query.folder_context:
        by_group: dict[int, list[str]] = {}
        for t in query.folder_context:
            by_group.setdefault(t.group, []).append(t.text)
        rows = rows.where(in_folder_context(F.col("full_path"), list(by_group.values()), tokens=tokens, name_tokens=name_tokens, separator=separator))
    if query.catalog is not None:
        rows = rows.where(replace(query.catalog, date_directories=True).column(separator) if expands or query.wants_folders else query.catalog.column(separator))
    return rows, values


def filtered(items: DataFrame, query: StructuredQuery, separator: str) -> DataFrame:
    """Items that pass the bounds, extensions and folders of a query, whatever their names.

    Hinted folders of a weight over 0.3 bind here. Directories are replaced by what lies below them, unless they are
    wanted or only files are; what comes out of them passes the bounds too.
    """
    catalog = query.catalog or CatalogFilter()
    expands = not (query.wants_folders or query.files_preferred)
    scan = replace(catalog, files=catalog.files and not query.folders_preferred, folders=catalog.folders and not query.files_preferred, date_directories=query.wants_folders)
    ok = scan.column(separator)
    if query.folder_hints:
        names = sorted({n for hint, weight in query.folder_hints if weight > 0.3 for n in (hint.lower(), *folder_synonyms(hint))})
        ok = ok & (has_segment(F.col("full_path"), names, separator) if names else F.lit(False))
    allowed = query.allowed_extensions
    typed = F.lower(extension(F.col("name"))).isin(allowed) if allowed else F.lit(True)
    if not expands:
        return items.where(ok & typed)
    parts = F.split("full_path", "\\Q" + separator + "\\E")
    above = F.transform(F.slice(F.sequence(F.lit(0), F.size(parts) - 1), F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))
    placed = items if "ancestors" in items.columns else items.withColumn("ancestors", above)
    matched = items.where(ok & (F.col("is_dir") | typed)).drop("ancestors")
    found = expand_folders(matched, placed, False, separator)
    if allowed:
        found = found.where(~F.col("is_dir") & typed)
    return found.where(replace(catalog, folders=True, date_directories=True).column(separator))


def expand_folders(matched: DataFrame, items: DataFrame, folders_preferred: bool, separator: str = "/") -> DataFrame:
    """Matched directories are replaced by what lies below them, unless directories are wanted; files stay.

    `items` has `ancestors`, the paths above each item, so expansion is an equality join and not a prefix test.
    """
    if folders_preferred:
        return matched
    folders = matched.where("is_dir").select(F.col("full_path").alias("__folder")).distinct()
    below = items.withColumn("__folder", F.explode("ancestors")).join(folders, "__folder").drop("__folder", "ancestors")
    return matched.where("NOT is_dir").unionByName(below).dropDuplicates(["full_path"])


def in_folder_context(path: Column, groups: list[list[str]], *, tokens: Callable[[str], list[str]] = lambda t: t.lower().split(), name_tokens: Callable[[Column], Column] = tokenize_ascii, separator: str = "/") -> Column:
    """For every group some term of which all tokens lie in one folder above: equal to a token there, or part of one
    from 4 characters on."""
    parts = F.split(path, "\\Q" + separator + "\\E")
    above = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.transform(name_tokens(s), fold_native))
    every = F.lit(True)
    for group in groups:
        one = F.lit(False)
        for term in group:
            if wanted := list(dict.fromkeys(fold_text(t) for t in tokens(term))):
                one = one | F.exists(above, _holds_all(wanted))
        every = every & one
    return every


def _holds_all(wanted: list[str]) -> Callable[[Column], Column]:
    """Whether a folder's tokens hold all of the wanted ones."""

    def holds(t: str) -> Callable[[Column], Column]:
        return lambda x: (x == t) | (F.contains(x, F.lit(t)) if len(t) >= 4 else F.lit(False))

    def every(folder: Column) -> Column:
        ok = F.lit(True)
        for t in wanted:
            ok = ok & F.exists(folder, holds(t))
        return ok

    return every


def affects(names: Column, pattern: str) -> Column:
    """Whether any of the changed names could change the result of a search for the pattern."""
    return F.exists(names, lambda n: F.contains(F.lower(n), F.lit(pattern.lower())))
