"""Line differences of two texts as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf



def common_lines(x: list[str], y: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Steps (op, first and last + 1 of x, of y) that keep a longest common subsequence, from its table of lengths."""
    ids: dict[str, int] = {}
    a, b = (np.array([ids.setdefault(line, len(ids)) for line in lines], np.int64) for lines in (x, y))
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        # a row's best is the diagonal plus one where lines agree, or what stands below or to the right
        row = np.maximum(best[i + 1, :-1], np.where(b == a[i], best[i + 1, 1:] + 1, 0))
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and a[i] == b[j]:
            step = ("equal", i, i + 1, j, j + 1)
        elif j == len(y) or i < len(x) and best[i + 1, j] >= best[i, j + 1]:
            step = ("delete", i, i + 1, j, j)
        else:
            step = ("insert", i, i, j, j + 1)
        out.append(step)
        i, j = step[2], step[4]
    return out


def line_diff(before: str, after: str, context: int = 3, most_cells: int = 250_000) -> list[tuple[str, int | None, int | None, str]]:
    """(op, line before, line after, text) with op same, add, del or skip (text: how many equal lines are folded away).

    Equal ends are cut off first; if the rest is too large to compare, lines are compared by their place.
    """
    a, b = before.split("\n"), after.split("\n")
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) * len(y) <= most_cells:
        codes = common_lines(x, y)
    else:
        n = min(len(x), len(y))
        codes = [("equal" if x[i] == y[i] else "replace", i, i + 1, i, i + 1) for i in range(n)] + [("replace", n, len(x), n, len(y))]
    rows: list[tuple] = [("same", i, i, a[i]) for i in range(head)]
    for op, i1, i2, j1, j2 in codes:
        if op == "equal":
            rows += [("same", head + i, head + j1 + i - i1, x[i]) for i in range(i1, i2)]
        else:
            rows += [("del", head + i, None, x[i]) for i in range(i1, i2)]
            rows += [("add", None, head + j, y[j]) for j in range(j1, j2)]
    rows += [("same", len(a) - tail + i, len(b) - tail + i, a[len(a) - tail + i]) for i in range(tail)]
    near = [False] * len(rows)
    for i, r in enumerate(rows):
        if r[0] != "same":
            for k in range(max(0, i - context), min(len(rows), i + context + 1)):
                near[k] = True
    out, hidden = [], 0
    for r, keep in zip(rows, near):
        if not keep:
            hidden += 1
            continue
        if hidden:
            out.append(("skip", None, None, str(hidden)))
            hidden = 0
        out.append(r)
    if hidden:
        out.append(("skip", None, None, str(hidden)))
    return out


@udtf(returnType="place int, op string, line_before int, line_after int, text string")
class LineDiff:
    def eval(self, before: str, after: str) -> Iterator[tuple]:
        for i, r in enumerate(line_diff(before or "", after or "")):
            yield (i, *r)


def register(spark: SparkSession) -> None:
    spark.udtf.register("line_diff", LineDiff)
