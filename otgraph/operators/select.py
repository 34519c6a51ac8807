"""Tag selection and simple event filters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otgraph.functions.events import is_good_quality, tag_provider

def select_explicit(df: DataFrame, paths: Sequence[str] | DataFrame, col: str = "tag_path"
                    ) -> DataFrame:
    """Keep events whose tag path is listed (F1). A Python list is trimmed and blanks are
    ignored. Both forms are semi-joins left to the planner, which knows a literal table's size."""
    if isinstance(paths, DataFrame):
        listed = paths.select(F.trim(F.col(paths.columns[0])).alias(col)) \
            .filter(F.col(col) != "").distinct()
        return df.join(listed, on=col, how="left_semi")
    clean = sorted({p.strip() for p in paths if p is not None and p.strip()})
    if not clean:
        return df.limit(0)
    listed = df.sparkSession.createDataFrame([(p,) for p in clean], f"{col} string")
    return df.join(listed, on=col, how="left_semi")


def select_folder(df: DataFrame, root: str, recursive: bool = True, col: str = "tag_path"
                  ) -> DataFrame:
    """Leaves under a folder; only direct children unless ``recursive`` (F2)."""
    prefix = root.strip().rstrip("/") + "/"
    under = F.col(col).startswith(prefix)
    if recursive:
        return df.filter(under)
    rest = F.substring(F.col(col), len(prefix) + 1, 1 << 30)
    return df.filter(under & ~rest.contains("/"))


def full_match(c: Column, regex: str) -> Column:
    """Whole-string regex match (``rlike`` alone finds a match anywhere)."""
    return c.rlike(f"^(?:{regex})$")


def select_pattern(df: DataFrame, regex: str, cap: int | None = None,
                   col: str = "tag_path", prune_providers: bool = True) -> DataFrame:
    """Events of tags whose path fully matches ``regex``.

    When the regex names its providers (F4), an ``IN`` on the provider is added so a scan
    partitioned by provider is pruned. All matching tags are kept; a caller who asks for a
    ``cap`` gets the events of the first ``cap`` matching tags in path order.
    """
    cond = full_match(F.col(col), regex)
    provs = provider_filter(regex) if prune_providers else None
    if provs:
        cond = tag_provider(F.col(col)).isin(provs) & cond
    hit = df.filter(cond)
    if cap is None:
        return hit
    tags = hit.select(col).distinct().orderBy(col).limit(int(cap))
    return hit.join(tags, on=col, how="left_semi")


_PROVIDER_RE = re.compile(r"^\^?\\\[(?:\(([A-Za-z0-9_\-|]+)\)|([A-Za-z0-9_\-]+))\\\]")


def provider_filter(regex: str) -> list[str] | None:
    """Providers a path regex can only match, read from a literal leading ``\\[name]`` or
    ``\\[(a|b)]``; None when the regex does not pin them, as with an alternation outside groups
    (F4). Driver-side parse of a parameter."""
    m = _PROVIDER_RE.match(regex.strip())
    if not m or _open_alternation(regex):
        return None
    names = (m.group(1) or m.group(2)).split("|")
    return sorted({n for n in names if n})


def _open_alternation(regex: str) -> bool:
    """Does ``|`` stand outside every group and character class?"""
    depth, in_class = 0, False
    for token in re.findall(r"\\.|.", regex, re.S):
        if in_class:
            in_class = token != "]"
        elif token == "[":
            in_class = True
        elif token in "()":
            depth += 1 if token == "(" else -1
        elif token == "|" and depth == 0:
            return True
    return False


def drop_initial(df: DataFrame, flag: str = "is_initial") -> DataFrame:
    """Ignore the initial value a subscription delivers (F8)."""
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def recent(df: DataFrame, col: str, interval: str, now, date_col: str = "event_date") -> DataFrame:
    """Rows with ``col >= now - interval`` (F9); ``now`` is a parameter, never the wall clock. On a
    table partitioned by the event's date the same bound prunes the older days' files."""
    now_c = now if isinstance(now, Column) else F.to_timestamp(F.lit(str(now)))
    since = now_c - F.expr(f"INTERVAL {interval}")
    cond = F.col(col) >= since
    if date_col in df.columns:
        cond = (F.col(date_col) >= F.to_date(since)) & cond
    return df.filter(cond)


def good_quality(df: DataFrame, col: str = "quality") -> DataFrame:
    """Quality text contains 'good' (F11)."""
    return df.filter(is_good_quality(F.col(col)))
