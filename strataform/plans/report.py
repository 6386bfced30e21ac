"""Readable reports of an analysis: a summary in sentences and a tree of all statistics."""

from __future__ import annotations

from ..operators.stats import quantile
from .shape import Node, is_map, tuple_length

#: Windows of numbers that look like times since 1970, by unit (fixed values).
EPOCHS = (("epoch seconds", 9e8, 3e9), ("epoch millis", 9e11, 3e12), ("epoch micros", 9e14, 3e15), ("epoch nanos", 9e17, 3e18))
#: Numbers at least for such a guess, share of a dominant format, ratio of p99 to p50 of a long tail.
EPOCH_LEAST, DOMINANT, LONG_TAIL = 8, 90.0, 10.0
FORMAT_ORDER = ("uuid", "iso-timestamp", "iso-date", "ipv4", "ipv6", "email", "url", "digits", "alpha", "alnum", "other")


def number_text(x: float, whole: bool) -> str:
    return f"{x:.0f}" if whole else f"{x:.3f}".rstrip("0").rstrip(".")


def whole(num: dict) -> bool:
    return num["n_whole"] == num["n_num"]


def epoch_guess(num: dict) -> str | None:
    """The unit if all numbers are whole, none negative, and they lie in one window."""
    if num["n_num"] < EPOCH_LEAST or not whole(num) or num["min"] < 0:
        return None
    return next((name for name, lo, hi in EPOCHS if lo <= num["min"] and num["max"] <= hi), None)


def range_hint(num: dict) -> str:
    sign = "all zero" if num["n_zero"] == num["n_num"] else "positive" if num["n_pos"] == num["n_num"] else "non-negative" if not num["n_neg"] else "negative" if num["n_neg"] == num["n_num"] else "mixed signs"
    return f"{'integers' if whole(num) else 'numbers'} {number_text(num['min'], whole(num))}..{number_text(num['max'], whole(num))}, {sign}"


def dominant(counts: dict[str, int], order: tuple[str, ...] = FORMAT_ORDER) -> tuple[str, float] | None:
    """The most frequent entry and its percentage; of equals the later in ``order``."""
    if not counts:
        return None
    best = max(counts, key=lambda k: (counts[k], order.index(k) if k in order else -1))
    return best, 100.0 * counts[best] / sum(counts.values())


def percentiles(buckets: dict[str, int], whole_: bool = True) -> str:
    return ", ".join(f"p{int(100 * q)}≈{number_text(quantile(buckets, q), whole_)}" for q in (0.5, 0.9, 0.99)) if buckets else ""


def evictions(node: Node) -> int:
    """Elements whose signatures are beyond those kept, over the node and all below."""
    lost = sum(node.buckets[f"all_{m}"].get("n", 0) - sum(node.buckets[m].values()) for m in ("signature", "skeleton") if m in node.buckets)
    return lost + sum(map(evictions, node.children))


def _leaf_lines(node: Node) -> list[str]:
    out = []
    if found := dominant(node.buckets["format"]):
        row = node.kinds["string"]
        name, share = found
        if share >= DOMINANT and name != "other":
            out.append(f"texts are {share:.0f}% {name}, {row['min_len']} to {row['max_len']} bytes")
        elif share >= DOMINANT and (top := dominant(node.buckets["skeleton"], ())) and node.buckets["skeleton"][top[0]] >= DOMINANT / 100 * node.buckets["all_skeleton"].get("n", 0):
            out.append(f"texts look like `{top[0]}`, {row['min_len']} to {row['max_len']} bytes")
    if num := node.number():
        p50, p99 = (quantile(node.buckets["number"], q) or 0.0 for q in (0.5, 0.99))
        tail = f", long-tailed ({percentiles(node.buckets['number'], whole(num))})" if p50 > 0 and p99 / p50 >= LONG_TAIL else ""
        guess = epoch_guess(num)
        out.append(range_hint(num) + (f", looks like {guess}" if guess else "") + tail)
    return out


def summary(root: Node | None, docs: int) -> str:
    """What each document is, in sentences."""
    if root is None or not docs:
        return "No documents were seen.\n"
    out = [f"{docs} document{'s' * (docs != 1)} seen."]
    kinds = ["scalar"] * bool(root.scalars) + [k for k in ("object", "array") if k in root.kinds]
    if len(kinds) > 1:
        out.append(f"They are of {len(kinds)} kinds: {', '.join(kinds)}.")
    for kind in kinds:
        if kind == "scalar":
            out.append(f"A document is one value: {', '.join(f'{k} {n}' for k, n in root.scalars.items())}.")
            out += [f"  {line}." for line in _leaf_lines(root)]
        elif kind == "object":
            yes, why = is_map(root)
            if yes:
                key = dominant(root.buckets["key_format"])
                out.append(f"A document is a map from keys to values ({why})" + (f"; keys are {key[1]:.0f}% {key[0]}" if key else "") + ".")
            else:
                total = root.kinds["object"]["n"]
                named = [f"{c.step}{'' if c.obs >= total else f' ({100 * c.obs / total:.0f}%)'}" for c in root.fields()]
                out.append(f"A document is a record of {len(named)} fields: {', '.join(named)}.")
                for c in root.fields():
                    out += [f"  {c.step}: {line}." for line in _leaf_lines(c)]
        else:
            length, why = tuple_length(root)
            out.append(f"A document is a tuple of {length} ({why})." if length else f"A document is a list ({why}), {root.kinds['array']['min_size']} to {root.kinds['array']['max_size']} long.")
    return "\n".join(out) + "\n"


def tree(node: Node, depth: int = 0) -> list[str]:
    """All statistics below a node, a line each."""
    pad = "  " * depth
    out = [f"{pad}{node.path}  {node.obs} seen, documents {node.first} to {node.last}"]
    total = max(sum(node.scalars.values()), 1)
    out += [f"{pad}  {k}  {n}  {100 * n / total:.1f}%" for k, n in node.scalars.items()]
    if "string" in node.kinds:
        row = node.kinds["string"]
        out.append(f"{pad}  bytes {row['min_len']} to {row['max_len']}, mean {row['sum_len'] / row['n_str']:.1f}; formats " + ", ".join(f"{k} {node.buckets['format'][k]}" for k in FORMAT_ORDER if k in node.buckets["format"]))
        if node.buckets["skeleton"]:
            out.append(f"{pad}  skeletons " + ", ".join(f"`{k}` {n}" for k, n in sorted(node.buckets["skeleton"].items(), key=lambda x: (-x[1], x[0]))))
    out += [f"{pad}  {line}" for line in _leaf_lines(node)]
    if "object" in node.kinds:
        row, (yes, why) = node.kinds["object"], is_map(node)
        out.append(f"{pad}  object  {row['n']} seen, {why}; keys each {percentiles(node.buckets['key_count'])}; {'MAP' if yes else 'RECORD'}")
        members = node.fields() + ([node.wildcard(False)] if node.wildcard(False) else [])
        for c in members:
            out += tree(c, depth + 1)
    if "array" in node.kinds:
        row, (length, why) = node.kinds["array"], tuple_length(node)
        lengths = sorted(((int(k), n) for k, n in node.buckets["length"].items()))
        out.append(f"{pad}  array  {row['n']} seen, length {row['min_size']} to {row['max_size']}, {percentiles(node.buckets['length_sketch'])}; {'TUPLE' if length else 'BAG'} ({why})")
        out.append(f"{pad}  lengths " + ", ".join(f"{k}: {n}" for k, n in lengths[:32]))
        out += [f"{pad}  element {n}  {s}" for s, n in sorted(node.buckets["signature"].items(), key=lambda x: (-x[1], x[0]))]
        for c in node.positions() + ([node.wildcard(True)] if node.wildcard(True) else []):
            out += tree(c, depth + 1)
    return out


def report(root: Node | None, docs: int) -> str:
    return summary(root, docs) + ("\n" + "\n".join(tree(root)) + "\n" if root else "")
