"""Order-dependent packing as native folds: each takes sizes in order and gives group numbers.

State is one pass over an array with running totals, so a fold costs the same for every item; the
token counter must be additive. Groups count from 0. Arrays belong to one document, section or
sheet (sheets are bounded by the row guard).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sql(name: str) -> str:
    return f"`{name}`"


def pack_before(sizes: str, limit: int | str) -> Column:
    """Close a group before an item would take it over ``limit``; an item alone may exceed it."""
    return F.expr(
        f"""aggregate({_sql(sizes)}, named_struct('ids', cast(array() as array<int>), 'g', -1, 't', 0L),
        (a, x) -> if(a.g >= 0 and a.t + x <= {limit},
            named_struct('ids', array_append(a.ids, a.g), 'g', a.g, 't', a.t + x),
            named_struct('ids', array_append(a.ids, a.g + 1), 'g', a.g + 1, 't', x)), a -> a.ids)"""
    )


def starts_before(sizes: str, limit: int | str) -> Column:
    """Where the groups of ``pack_before`` begin, counted from 1: a fold that keeps a number a group, not
    one an item."""
    return F.expr(
        f"""aggregate({_sql(sizes)}, named_struct('s', cast(array() as array<int>), 'i', 1, 't', 0L),
        (a, x) -> if(a.i > 1 and a.t + x <= {limit},
            named_struct('s', a.s, 'i', a.i + 1, 't', a.t + x),
            named_struct('s', array_append(a.s, a.i), 'i', a.i + 1, 't', x)), a -> a.s)"""
    )


def cut(items: Column, starts: Column) -> Column:
    """The stretches of ``items`` that begin at ``starts``; linear, as each item is copied once."""
    upto = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(items) + 1))
    return F.filter(F.zip_with(starts, upto, lambda a, b: F.slice(items, a, b - a)), lambda part: part.isNotNull())  # none of no items


def pack_after(sizes: str, target: int, most: int) -> Column:
    """Close a group once it has ``most`` items or ``target`` tokens."""
    full = f"(a.n + 1 >= {most} or a.t + x >= {target})"
    return F.expr(
        f"""aggregate({_sql(sizes)}, named_struct('ids', cast(array() as array<int>), 'g', 0, 'n', 0, 't', 0L),
        (a, x) -> named_struct('ids', array_append(a.ids, a.g), 'g', a.g + if({full}, 1, 0),
            'n', if({full}, 0, a.n + 1), 't', if({full}, 0L, a.t + x)), a -> a.ids)"""
    )


def merge_small(sizes: str, least: int) -> Column:
    """An item joins the group before it while that has fewer than ``least``; a small last group
    joins its neighbour."""
    return F.expr(
        f"""aggregate({_sql(sizes)}, named_struct('ids', cast(array() as array<int>), 'g', -1, 't', 0L),
        (a, x) -> if(a.g >= 0 and a.t < {least},
            named_struct('ids', array_append(a.ids, a.g), 'g', a.g, 't', a.t + x),
            named_struct('ids', array_append(a.ids, a.g + 1), 'g', a.g + 1, 't', x)),
        a -> if(a.g > 0 and a.t < {least}, transform(a.ids, i -> least(i, a.g - 1)), a.ids))"""
    )


def carry_short(items: str, least: int) -> Column:
    """Pages ``struct<n, tb>``: one of fewer than ``least`` tokens and without tables goes on into the next."""
    stay = f"(a.t + x.n < {least} and not x.tb)"
    return F.expr(
        f"""aggregate({_sql(items)}, named_struct('ids', cast(array() as array<int>), 'g', 0, 't', 0L),
        (a, x) -> named_struct('ids', array_append(a.ids, a.g), 'g', a.g + if({stay}, 0, 1),
            't', if({stay}, a.t + x.n, 0L)), a -> a.ids)"""
    )


def heading_paths(headings: str) -> Column:
    """For headings ``struct<l, x>`` in order, the path of texts to each: a heading ends those of its
    level and below."""
    return F.expr(
        f"""aggregate({_sql(headings)}, named_struct('out', cast(array() as array<array<string>>), 'st', cast(array() as array<struct<l:int,x:string>>)),
        (a, h) -> named_struct(
            'out', array_append(a.out, transform(array_append(filter(a.st, y -> y.l < h.l), h), y -> y.x)),
            'st', array_append(filter(a.st, y -> y.l < h.l), h)), a -> a.out)"""
    )
