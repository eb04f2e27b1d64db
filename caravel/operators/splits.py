"""Snapshot splits: predicates that cover a table exactly once. Statistics propose boundaries; they never define the row set."""

from __future__ import annotations


def range_predicates(column: str, boundaries: list) -> list[str]:
    """Half-open ranges with open tails, boundaries in ascending order; the first also takes nulls."""
    cuts = list(dict.fromkeys(boundaries))
    if not cuts:
        return ["TRUE"]
    out = [f"({column} < {cuts[0]} OR {column} IS NULL)"]
    out += [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [*out, f"{column} >= {cuts[-1]}"]


def equal_ranges(column: str, low: int, high: int, parts: int) -> list[str]:
    """Integer arithmetic only, so keys beyond 2**53 keep their identity."""
    return range_predicates(column, [low + (high - low) * i // parts for i in range(1, parts)] if high > low else [])


def hash_predicates(expression: str, parts: int) -> list[str]:
    """Non-negative remainders of a hash; nulls go to bucket 0."""
    return [f"coalesce(pmod({expression}, {parts}), 0) = {i}" for i in range(parts)]


def single() -> list[str]:
    """One scan of everything."""
    return ["TRUE"]


def page_ranges(pages: int, parts: int) -> list[str]:
    """Equal ranges of a heap's pages by row address, half-open, with an open tail for pages that appear later."""
    return weighted_page_ranges([1.0] * max(1, pages), parts)


def weighted_page_ranges(weights: list[float], parts: int) -> list[str]:
    """Ranges of pages of about equal weight, where a sample gave each page's output; a missing estimate is unknown and counts as the mean."""
    known = [w for w in weights if w is not None]
    mean = sum(known) / len(known) if known else 1.0
    filled = [mean if w is None else w for w in weights]
    total, held, cuts = sum(filled) or 1.0, 0.0, []
    for page, w in enumerate(filled):
        if cuts and page == cuts[-1]:
            held += w
            continue
        if held >= total * (len(cuts) + 1) / parts and len(cuts) < parts - 1:
            cuts.append(page)
        held += w
    return range_predicates("ctid", [f"'({c},0)'::tid" for c in cuts]) if cuts else single()


def halved(low: int, high: int, pending: bool) -> list[tuple[int, int]]:
    """A pending range of two pages or more as its halves; one that is being read stays whole."""
    middle = (low + high) // 2
    return [(low, middle), (middle, high)] if pending and high - low >= 2 else [(low, high)]


#: Declared rates of a planner (fixed values): heap and output bytes, rows and hashed rows a second, and seconds per column and row.
RATES = {"heap": 1 << 30, "output": 256 << 20, "rows": 10_000_000, "hash": 20_000_000, "column": 10e-9}


def seconds(strategy: str, heap_bytes: int, output_bytes: int, rows: int | None, columns: int, readers: int) -> float | None:
    """What a strategy would take; None where the rows are unknown, which is not zero. Hash buckets scan the whole heap in each reader."""
    if rows is None:
        return None
    own = output_bytes / RATES["output"] + rows / RATES["rows"] + rows * columns * RATES["column"]
    scan = heap_bytes / RATES["heap"]
    if strategy == "single":
        return scan + own
    if strategy == "hash":
        return scan + rows / RATES["hash"] + own / readers
    return (scan + own) / readers


def plan(eligible: dict[str, bool], heap_bytes: int, output_bytes: int, rows: int | None, columns: int, readers: int) -> str:
    """The cheapest eligible strategy; eligibility comes before cost, and unknown rows mean a single scan unless ranges are eligible."""
    ok = [s for s in ("single", "pages", "index", "hash") if s == "single" or eligible.get(s)]
    costs = {s: seconds(s, heap_bytes, output_bytes, rows, columns, readers) for s in ok}
    if any(c is None for c in costs.values()):
        return next((s for s in ("pages", "index") if s in ok), "single")
    return min(ok, key=lambda s: (costs[s], ok.index(s)))
