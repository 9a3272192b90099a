"""Secret scans with one combined deterministic automaton.

The rules' regexes become one NFA over reversed bytes, subset construction and minimisation give a DFA, and one pass
over the bytes from the end flags every position where some rule can start. Only from flagged starts does a rule's
own forward automaton run, to find the longest match; matches of a rule don't overlap, leftmost first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import mapped, remembering

#: Rules in their order: kind, pattern. Sets, groups, `?`, `+`, `*` and `{n}` / `{n,}` are understood.
#: The first three are the contract's; minimum lengths that can't change where a match starts are in the pattern.
#: `assign` consumes short values too, as the contract says, and drops them afterwards.
RULES = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"),
    ("access", r"AKIA[A-Z0-9]{12,}"),
    ("hex", r"[0-9a-f]{32,}"),
    ("github", r"gh[pousr]_[A-Za-z0-9]+"),
    ("pem", r"-----BEGIN ((RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY|PGP PRIVATE KEY BLOCK)-----"),
)
#: What a match takes in behind its rule's pattern, which alone tells where a match starts. A key runs to its END line
#: if no other five dashes come before that; an unclosed one takes base64, line breaks (escaped ones too) and PEM
#: headers, as far as they go.
TAILS = {
    "pem": r"(([\x00-\x2c\x2e-\xff]|-[\x00-\x2c\x2e-\xff]|--[\x00-\x2c\x2e-\xff]|---[\x00-\x2c\x2e-\xff]|----[\x00-\x2c\x2e-\xff])*-----END [A-Z ]+-----"
    r"|[A-Za-z0-9+/=]*([\x20\x09]*(\x0d|\x0a|\x5cr|\x5cn)+([\x20\x09]*[A-Za-z0-9+/=]+|(Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[\x00-\x09\x0b\x0c\x0e-\x5b\x5d-\xff]*)?)*)",
}
#: Lengths below which a match is consumed and then dropped: of the value for `assign`, else of the whole match.
LEAST = {"assign": 8, "github": 40}


# Patterns are parsed to trees: ("set", frozenset), ("cat", [..]), ("alt", [..]), ("rep", tree, least, most or None).
def parse(pattern: str) -> tuple:
    data, at = pattern.encode("latin-1"), 0

    def alternatives() -> tuple:
        nonlocal at
        found = [sequence()]
        while at < len(data) and data[at] == ord("|"):
            at += 1
            found.append(sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence() -> tuple:
        nonlocal at
        found = []
        while at < len(data) and data[at] not in b"|)":
            item = atom()
            while at < len(data) and data[at] in b"?*+{":
                item = repeated(item)
            found.append(item)
        return ("cat", found)

    def repeated(item: tuple) -> tuple:
        nonlocal at
        sign = data[at]
        at += 1
        if sign != ord("{"):
            return ("rep", item, *{ord("?"): (0, 1), ord("*"): (0, None), ord("+"): (1, None)}[sign])
        end = data.index(b"}", at)
        least, comma, most = data[at:end].partition(b",")
        at = end + 1
        return ("rep", item, int(least), (int(most) if most else None) if comma else int(least))

    def escaped() -> int:
        nonlocal at
        at += 1
        if data[at] == ord("x"):
            at += 2
            return int(data[at - 1 : at + 1], 16)
        return data[at]

    def atom() -> tuple:
        nonlocal at
        c = data[at]
        if c == ord("("):
            at += 1
            inner = alternatives()
            at += 1
            return inner
        if c == ord("["):
            return ("set", members())
        if c == ord("\\"):
            c = escaped()
        at += 1
        return ("set", frozenset([c]))

    def members() -> frozenset:
        nonlocal at
        at += 1
        found: list[int] = []
        while data[at] != ord("]"):
            c = escaped() if data[at] == ord("\\") else data[at]
            at += 1
            if data[at] == ord("-") and data[at + 1] != ord("]"):
                at += 1
                last = escaped() if data[at] == ord("\\") else data[at]
                at += 1
                found += range(c, last + 1)
            else:
                found.append(c)
        at += 1
        return frozenset(found)

    return alternatives()


def turned(tree: tuple) -> tuple:
    """The tree of the reversed language."""
    kind = tree[0]
    if kind == "cat":
        return ("cat", [turned(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [turned(x) for x in tree[1]])
    return ("rep", turned(tree[1]), *tree[2:]) if kind == "rep" else tree


class Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Build `tree` from `start`; its end state."""
        kind = tree[0]
        if kind == "set":
            here, end = self.state(), self.state()
            self.free[start].append(here)
            self.step[here] = (tree[1], end)
            return end
        if kind == "cat":
            for x in tree[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in tree[1]:
                self.free[self.add(x, start)].append(end)
            return end
        _, inner, least, most = tree
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.free[start].append(end)
        for _ in range(most - least):
            start = self.add(inner, start)
            self.free[start].append(end)
        return end


@dataclass(frozen=True)
class Dfa:
    #: rows[s][byte] is the next state's number; accepts[s] the rules that end in s, as bits; the start is 0.
    rows: tuple[tuple[int, ...], ...]
    accepts: tuple[int, ...]
    #: The state with no way to accept, or -1.
    dead: int


def determinise(trees: list[tuple], anywhere: bool) -> Dfa:
    """Subset construction over byte classes, then minimisation by partition refinement.

    anywhere: a match may begin at every byte, not only at the first.
    """
    nfa = Nfa()
    root = nfa.state()
    ends = {nfa.add(t, root): k for k, t in enumerate(trees)}
    sets = list({x[0] for x in nfa.step if x})
    by_kind: dict[tuple, int] = {}
    kinds = [by_kind.setdefault(tuple(b in s for s in sets), len(by_kind)) for b in range(256)]
    sample = {k: b for b, k in reversed(list(enumerate(kinds)))}

    def closed(states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for y in nfa.free[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return frozenset(s for s in seen if nfa.step[s] or s in ends)

    first = closed({root})
    number, order, moves = {first: 0}, [first], []
    for states in order:
        row = []
        for k in range(len(by_kind)):
            to = {nfa.step[s][1] for s in states if nfa.step[s] and sample[k] in nfa.step[s][0]}
            new = closed(to | {root}) if anywhere else closed(to)
            if new not in number:
                number[new] = len(order)
                order.append(new)
            row.append(number[new])
        moves.append(row)
    accepts = [sum(1 << ends[s] for s in states if s in ends) for states in order]
    # Refinement: states stay together while they accept alike and move to alike states.
    block, count = accepts, 0
    while True:
        keys: dict[tuple, int] = {}
        block = [keys.setdefault((accepts[s], block[s], *(block[t] for t in moves[s])), len(keys)) for s in range(len(order))]
        if len(keys) == count:
            break
        count = len(keys)
    rows: list[tuple[int, ...]] = [()] * count
    ends_in = [0] * count
    for s, b in enumerate(block):
        rows[b], ends_in[b] = tuple(block[moves[s][k]] for k in kinds), accepts[s]
    dead = next((b for b in range(count) if not ends_in[b] and set(rows[b]) == {b}), -1)
    return Dfa(tuple(rows), tuple(ends_in), dead)


@lru_cache(maxsize=4)
def compiled(rules: tuple[tuple[str, str], ...]) -> tuple[list, list[Dfa]]:
    """The combined reversed automaton, as linked rows whose entry 256 holds the rules that start there, and each rule's own forward one, with its tail."""
    trees = [parse(p) for _, p in rules]
    back = determinise([turned(t) for t in trees], anywhere=True)
    linked: list[list] = [[] for _ in back.rows]
    for s, row in enumerate(back.rows):
        linked[s].extend(linked[t] for t in row)
        linked[s].append(back.accepts[s])
    return linked, [determinise([parse(p + TAILS.get(kind, ""))], anywhere=False) for kind, p in rules]


def scan_bytes(data: bytes, rules: tuple[tuple[str, str], ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule number, end) of all matches, in bytes, by start and then by rule."""
    linked, forward = compiled(rules)
    starts: list[tuple[int, int]] = []
    state, at = linked[0], len(data)
    for b in reversed(data):
        at -= 1
        state = state[b]
        if state[256]:
            starts.append((at, state[256]))
    starts.reverse()
    found, free = [], [0] * len(rules)
    for start, bits in starts:
        for k in range(len(rules)):
            if bits >> k & 1 and start >= free[k]:
                dfa, s, end = forward[k], 0, start
                for i in range(start, len(data)):
                    s = dfa.rows[s][data[i]]
                    if s == dfa.dead:
                        break
                    if dfa.accepts[s]:
                        end = i + 1
                free[k] = end
                if (value_length(data, start, end) if rules[k][0] == "assign" else end - start) >= LEAST.get(rules[k][0], 0):
                    found.append((start, k, end))
    return found


def value_length(data: bytes, start: int, end: int) -> int:
    """Bytes of the value in an `assign` match: behind the first separator (keywords have none), spaces and a quote."""
    at = start
    while data[at] not in b":=":
        at += 1
    at += 1
    while data[at] == 0x20:
        at += 1
    return end - at - (data[at] in b"\"'")


def spans_of(text: str | None, rules: tuple[tuple[str, str], ...] = RULES) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = scan_bytes(data, rules)
    if not found or len(data) == len(text):
        return [(s, rules[k][0], e) for s, k, e in found]
    cuts = sorted({x for s, _, e in found for x in (s, e)})
    points, done, last = {}, 0, 0
    for c in cuts:
        done += len(data[last:c].decode("utf-8", "surrogatepass"))
        points[c], last = done, c
    return [(points[s], rules[k][0], points[e]) for s, k, e in found]


def scan(docs: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, text: str = "text", id: str = "doc_id") -> DataFrame:
    """All matches of all rules: id, spans array<struct<start, kind, end>> in code points, by start and then by rule.

    Whole texts are scanned, one pass each, within a map stage without shuffle. A null text or an empty one gives an
    empty array, a null id stays null, repeated rows each get theirs, an empty table gives none. Further columns of
    `docs` are left out.
    """

    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("secrets")
        for part in batches:
            spans = [[{"start": s, "kind": k, "end": e} for s, k, e in spans_of(t, rules)] for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(id), pa.array(spans, spans_type)], [id, "spans"])

    kind = docs.schema[id].dataType.simpleString()
    return mapped(docs.select(id, F.col(text).alias("_text")), scanned, f"{id} {kind}, spans array<struct<start:long,kind:string,end:long>>")


def masked(text: str | None, rules: tuple[tuple[str, str], ...] = RULES) -> str | None:
    """The text with a mark in place of every span; itself without any."""
    out, at = [], 0
    for s, k, e in spans_of(text, rules):
        if s >= at:
            out += [text[at:s], f"[{k}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """`docs` with every matched span replaced by `[kind]`; overlapping spans become one mark, of the first kind.

    Columns stay, whatever their names; `n_chars`, if there, follows the new text. Documents without secrets, with a
    null text or an empty one are unchanged, a null id doesn't matter, repeated rows stay repeated, an empty table stays
    empty, long texts are scanned whole.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("secrets")
        for part in batches:
            old = part.column("text").to_pylist()
            new = [masked(t, rules) for t in old]
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            columns["text"] = pa.array(new, part.schema.field("text").type)
            if "n_chars" in columns:
                sizes = [n if a is b else len(b) for n, a, b in zip(columns["n_chars"].to_pylist(), old, new, strict=True)]
                columns["n_chars"] = pa.array(sizes, part.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return mapped(docs, made, docs.schema)


def digest_columns(scanned: DataFrame, id: str = "doc_id") -> DataFrame:
    """The contract's columns from `scan`'s spans."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return scanned.select(
        id, count("assign"), count("access"), count("hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
