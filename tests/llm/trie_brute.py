"""The prefix trie by plain Python: the contract read literally."""

import hashlib
import zlib
from collections import defaultdict


def rebuilt(rows, base=100, kept=6):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs[conv_id].append((turn is not None, turn if turn is not None else 0, role or "", text or ""))
    ordered = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, own in ordered.items():
        h = zlib.crc32(str(c).encode()) % kept
        b = c - (abs(c) % base) * (1 if c >= 0 else -1)
        out[c] = ordered.get(b, [])[:h] + own[h:]
    return out


def trie(rows, **options):
    convs = rebuilt(rows, **options)
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for key in nodes:
        if key:
            children[key[:-1]].append(key)
    memo = {}

    def sub(key):
        if key not in memo:
            own = (len(nodes[key]) - 1) * (len(key[-1][1]) if key else 0)
            kids = [sub(k) for k in children[key]]
            memo[key] = (sum(k[0] for k in kids) if kids else 1, own + sum(k[1] for k in kids))
        return memo[key]

    out = []
    for key, ms in nodes.items():
        leaves, saved = sub(key)
        ends = ",".join(str(c) for c in sorted(c for c in ms if len(convs[c]) == len(key)))
        out.append((min(ms), len(key), min(nodes[key[:-1]]) if key else None, len(ms), len(children[key]), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)
