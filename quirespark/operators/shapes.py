"""Folds over the shapes of one page: tolerance dedupe, unions, grids, choices, breaks.

Each keeps an anchor and visits in order, so a window over neighbours would give other
answers; they run per page through ``layout.page_fold`` or ``rules.by_document``."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable

Box = tuple[float, float, float, float]
TOLERANCE = 0.0006


def dedupe_shapes(shapes: Iterable[tuple[str, Box]], tolerance: float = TOLERANCE) -> list[tuple[str, Box]]:
    """Top down and left to right; a shape goes when a kept earlier one of its kind has
    all four edges within the tolerance."""
    kept: list[tuple[str, Box]] = []
    for kind, box in sorted(shapes, key=lambda s: (s[1][1], s[1][0], s[1][3], s[1][2], s[0])):
        if not any(k == kind and all(abs(a - b) <= tolerance for a, b in zip(box, other)) for k, other in kept):
            kept.append((kind, box))
    return kept


def area(box: Box) -> float:
    return max(0.0, box[2] - box[0]) * max(0.0, box[3] - box[1])


def overlap(a: Box, b: Box) -> float:
    return area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))


def union_area(boxes: list[Box]) -> float:
    """Area of a union, each point once: strips between the boxes' edges."""
    xs, total = sorted({x for b in boxes for x in (b[0], b[2])}), 0.0
    by_height = sorted((b[1], b[3], b[0], b[2]) for b in boxes)
    for left, right in zip(xs, xs[1:]):
        reach, height = float("-inf"), 0.0
        for lo, hi, x0, x1 in by_height:
            if hi > reach and hi > lo and x0 <= left and x1 >= right:
                height += hi - (lo if lo > reach else reach)
                reach = hi
        total += height * (right - left)
    return total


def dedupe_groups(groups: list[Box], share: float = 0.5) -> list[int]:
    """Positions that stay: a later group goes when it overlaps a kept one by more than
    the share of the smaller area."""
    kept: list[int] = []
    for k, g in enumerate(groups):
        if not any(overlap(g, groups[j]) > share * min(area(g), area(groups[j])) for j in kept):
            kept.append(k)
    return kept


def merge_rules(rules: list[tuple[float, float, float]], tolerance: float = 1.0) -> list[tuple[float, float, float]]:
    """Rules (position, from, to) on about one line whose ends meet are one."""
    out: list[list[float]] = []
    near = 0  # rules come by position: those before are too far from all that follow
    for at, lo, hi in sorted(rules):
        while near < len(out) and at - out[near][0] > tolerance:
            near += 1
        for k in range(near, len(out)):
            own = out[k]
            if lo <= own[2] + tolerance and hi >= own[1] - tolerance:
                own[1], own[2] = min(own[1], lo), max(own[2], hi)
                break
        else:
            out.append([at, lo, hi])
    return [tuple(r) for r in out]


def ruled_grids(across: list[tuple[float, float, float]], upright: list[tuple[float, float, float]], tolerance: float = 1.0) -> list[tuple[list[float], list[float], bool]]:
    """(rows' edges, columns' edges, regular) of each set of crossing rules with at least
    2 x 2 cells; a grid in which a crossing is missing is reported as not regular."""
    across = merge_rules(across, tolerance) if len(across) >= 3 and len(upright) >= 3 else []
    upright = merge_rules(upright, tolerance) if len(across) >= 3 else []
    if len(upright) < 3:  # no 2 x 2 cells
        return []
    crosses = lambda h, v: h[1] - tolerance <= v[0] <= h[2] + tolerance and v[1] - tolerance <= h[0] <= v[2] + tolerance
    over = [[j for j, v in enumerate(upright) if crosses(h, v)] for h in across]
    under: dict[int, list[int]] = {}
    for i, own in enumerate(over):
        for j in own:
            under.setdefault(j, []).append(i)
    left, out = set(range(len(across))), []
    while left:
        start = left.pop()
        hs, vs, fresh = {start}, set(), [start]
        while fresh:
            more = {j for i in fresh for j in over[i]} - vs
            vs |= more
            fresh = {i for j in more for i in under[j]} & left
            hs |= fresh
            left -= fresh
        ys, xs = sorted(across[i][0] for i in hs), sorted(upright[j][0] for j in vs)
        if len(ys) >= 3 and len(xs) >= 3:
            out.append((ys, xs, all(len(over[i]) == len(vs) for i in hs)))
    return out


def break_greedy(items: list, most: float, width: Callable[[list], float]) -> list[list]:
    """Lines of items no wider than ``most``; an item that is wider stands alone."""
    lines: list[list] = []
    for item in items:
        if lines and width([*lines[-1], item]) <= most:
            lines[-1].append(item)
        else:
            lines.append([item])
    return lines


#: Networks that no public host has, beside private, loopback, link-local and multicast ones.
RESERVED = tuple(map(ipaddress.ip_network, (
    "0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "198.18.0.0/15", "192.88.99.0/24", "240.0.0.0/4",
    "::/96", "2001:20::/28", "2001:db8::/32", "3fff::/20", "2001::/32", "2002::/16", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "5f00::/16", "fec0::/10",
)))
PRIVATE = tuple(map(ipaddress.ip_network, ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7")))


def routable(address: str) -> bool:
    """Whether an address is a public host's. A mapped one is what it maps to, and a zone
    changes nothing; what is no address is not."""
    try:
        found = ipaddress.ip_address(address.partition("%")[0] if ":" in address else address)
    except ValueError:
        return False
    found = getattr(found, "ipv4_mapped", None) or found
    if found.is_unspecified or found.is_loopback or found.is_multicast or found.is_link_local or found == ipaddress.ip_address("255.255.255.255"):
        return False
    return not any(found in network for network in (*RESERVED, *PRIVATE) if network.version == found.version)


#: Fixed values, in points: least field, squares that are check boxes, room above a bare line.
FIELD, SQUARE, SQUARENESS, ROOM = (14.0, 7.0), (5.0, 20.0), 4.0, 15.0


def propose_fields(squares: list[Box], lines: list[tuple[float, float, float]], taken: list[Box]) -> list[tuple[str, Box]]:
    """Fields that shapes suggest: empty squares are check boxes, bare lines (y, from,
    to; y grows downwards) carry a text field above. What overlaps a widget or an earlier
    proposal is not proposed."""
    out: list[tuple[str, Box]] = []
    free = lambda box: not any(overlap(box, b) > 0 for b in [*taken, *(b for _, b in out)])
    for box in sorted(squares, key=lambda b: (b[1], b[0])):
        w, h = box[2] - box[0], box[3] - box[1]
        if SQUARE[0] <= w <= SQUARE[1] and SQUARE[0] <= h <= SQUARE[1] and abs(w - h) < SQUARENESS and free(box):
            out.append(("check", box))
    for y, lo, hi in sorted(lines):
        box = (lo, y - ROOM, hi, y)
        if hi - lo >= FIELD[0] and free(box):
            out.append(("text", box))
    return out
