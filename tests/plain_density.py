"""Edges, cores, reachability, components, seeds and clusters of a few messages by plain loops."""

import math
from collections import defaultdict


def cell(r, p):
    return math.floor((r[1] + 180.0) / p.cell), math.floor((r[2] + 90.0) / p.cell)


def distance(a, b):
    dot = lambda x, y: sum(i * j for i, j in zip(x, y, strict=True))
    return round(max(0.0, 1 - dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))), 9)


def groups(nodes, links):
    """node -> least node of its component."""
    label = {n: n for n in nodes}
    while True:
        new = {n: min([label[n], *(label[m] for m in links[n] if m in label)]) for n in nodes}
        if new == label:
            return label
        label = new


def plain_state(rows, seeds, p):
    """``rows``: (id, lon, lat, uid, words, vector); ``seeds``: (seed_idx, vector)."""
    near = defaultdict(dict)
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            (x, y), (u, v) = cell(a, p), cell(b, p)
            if max(abs(x - u), abs(y - v)) <= p.reach_cells and set(a[4]) & set(b[4]) and (d := distance(a[5], b[5])) <= p.epsilon:
                near[a[0]][b[0]] = near[b[0]][a[0]] = d
        for s, vector in seeds:
            if (d := distance(a[5], vector)) <= p.epsilon:
                near[a[0]][-s - 1] = near[-s - 1][a[0]] = d
    ids = [r[0] for r in rows]
    core = {i: sorted(near[i].values())[p.min_points - 1] if len(near[i]) >= p.min_points else p.epsilon + 1 for i in ids}
    known = lambda j: 0.0 if j < 0 else core[j]
    reach = {i: min([p.epsilon + 1, *(max(d, known(j)) for j, d in near[i].items() if known(j) <= p.epsilon)]) for i in ids}
    cores = {i for i in ids if core[i] <= p.epsilon}
    comp = groups(cores, {i: [j for j in near[i] if j in cores] for i in cores})
    touch = {i: [-j - 1 for j in near[i] if j < 0] for i in ids}
    owner = defaultdict(list)
    for i in cores:
        owner[comp[i]] += touch[i]
    member = {i: min(owner[comp[i]]) for i in cores if owner[comp[i]]}
    for i in set(ids) - cores:
        if own := touch[i] + [member[j] for j in near[i] if j in member and j in cores]:
            member[i] = min(own)
    cut = min(p.epsilon, p.reach_max)
    inside = {i: s for i, s in member.items() if p.reach_min <= reach[i] <= p.reach_max}
    node = {i: (s, core[i] <= cut) for i, s in inside.items()} | {-s - 1: (s, True) for s in inside.values()}
    links = {i: [j for j, d in near[i].items() if d <= cut and j in node and node[j][0] == node[i][0]] for i in node}
    full = {i for i in node if node[i][1]}
    label = groups(full, {i: [j for j in links[i] if j in full] for i in full})
    for i in set(node) - full:
        if own := [label[j] for j in links[i] if j in full]:
            label[i] = min(own)
    return {
        "edges": [(d, j, i) for i in near for j, d in near[i].items()],  # by the names of the columns: dist, dst, src
        "core": [(c, i) for i, c in core.items()],
        "reach": [(i, r) for i, r in reach.items()],
        "comp": list(comp.items()),
        "member": list(member.items()),
        "clusters": [(i, label[i], s) for i, s in inside.items() if i in label],
    }
