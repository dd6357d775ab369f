"""Secret scans by grammar inference.

The plain patterns find credentials of three kinds, and those serve as labelled examples. Their
characters are replaced by classes, the prefix tree of each kind is counted over the corpus, and
statistically compatible states are merged (state merging by Hoeffding bounds) into a
probabilistic automaton, whose moves are then counted anew over all whole credentials. Every other candidate run of characters is scored by its likelihood
under each format against ordinary text, and those that look like a credential become spans too.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raingrid.llm import frames
from raingrid.session import written

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run that is too short holds no longer one
#: Every run that an assigned credential could be, which are those of six characters or more.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")

#: Classes of characters and how many characters each holds; all others stand for themselves.
_CLASSES = {"0": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF",
            "G": "GHIJKLMNOPQRSTUVWXYZ"}
_CLASS_OF = str.maketrans({c: k for k, cs in _CLASSES.items() for c in cs})
_SIZE = {k: len(cs) for k, cs in _CLASSES.items()}
#: Confidence of the Hoeffding test, and the examples a state of a prefix tree must hold: with
#: fewer, no difference between two such states is beyond the bound (8 at 0.05).
ALPHA = 0.05
LEAST_EXAMPLES = math.ceil(2 * math.log(2 / ALPHA))
#: Classes that a credential can hold, by slot; the slot after the last is the end.
_SLOTS = "0agAG+/_.=-"
_SLOT_OF = {c: i for i, c in enumerate(_SLOTS)}


def shape(value: str) -> str:
    return value.translate(_CLASS_OF)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the plain patterns, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        at = 0
        for line in text.split("\n"):  # no match goes beyond a line
            if ":" in line or "=" in line:
                out += [(at + m.start(), at + m.end(), 0) for m in _ASSIGN.finditer(line)
                        if len(m[2]) >= 6]
            at += len(line) + 1
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def disjoint(spans) -> list[tuple[int, int]]:
    """Spans joined where they overlap, by start."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def value_of(text: str, start: int, end: int, kind: int) -> str:
    """The credential itself: of an assignment, what is assigned."""
    return _ASSIGN.match(text, start, end)[2] if kind == 0 else text[start:end]


def candidates(text: str, base) -> list[tuple[int, int]]:
    """All runs of credential characters that overlap no base span."""
    out = [m.span() for m in _CANDIDATE.finditer(text)]
    if base:
        out = [(s, e) for s, e in out if not any(s < be and bs < e for bs, be, _ in base)]
    return out


class Automaton:
    """A probabilistic automaton over character classes."""

    def __init__(self, moves, ends, visits):
        self.moves, self.ends, self.visits = moves, ends, visits

    def log_likelihood(self, value: str) -> float:
        """Natural log of the chance of ``value`` (or its shape), its end included.

        A state's chances, with one half added to every count, add up to one over the classes and
        the end; a class shares its chance among its characters.
        """
        state, total, slots = 0, 0.0, len(_SLOTS) + 1
        for c in shape(value):
            found = self.moves.get(state, {}).get(c)
            n = found[1] if found else 0
            total += math.log((n + 0.5) / (self.visits.get(state, 0) + 0.5 * slots))
            total -= math.log(_SIZE.get(c, 1))
            state = found[0] if found else state
        return total + math.log((self.ends.get(state, 0) + 0.5) / (self.visits.get(state, 0) + 0.5 * slots))


class Ordinary:
    """Ordinary text: each class of a run, and its end, has a chance given the class before it."""

    def __init__(self, counts, secrets: int):
        """``counts``: pairs of neighbouring slots, the last slot being the outside of a run;
        ``secrets``: labelled credentials."""
        size = len(_SLOTS) + 1
        pairs = np.array(counts, float).reshape(size, size)
        pairs[-1, -1] = 0
        chance = (pairs + 0.5) / (pairs.sum(1, keepdims=True) + 0.5 * size)
        self.logs = np.log(chance / [_SIZE.get(c, 1) for c in _SLOTS + " "]).tolist()
        #: Log of how many credentials there are for each ordinary run.
        self.prior = math.log((secrets + 0.5) / (pairs[-1].sum() + 0.5))

    def log_likelihood(self, shaped: str) -> float:
        total, before = 0.0, len(_SLOTS)
        for slot in _slots(shaped):
            total += self.logs[before][slot]
            before = slot
        return total


def infer(prefixes: dict[str, int], ends: dict[str, int], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of a counted prefix tree.

    ``prefixes`` counts the examples that begin with a string ("" counts all), ``ends`` those
    that are it.
    """
    order = sorted(prefixes, key=lambda p: (len(p), p))
    number = {p: i for i, p in enumerate(order)}
    children: dict[int, dict[str, list]] = {}
    for p in order[1:]:
        children.setdefault(number[p[:-1]], {})[p[-1]] = [number[p], prefixes[p]]
    return merge_states(children, {number[p]: n for p, n in prefixes.items()},
                        {number[p]: n for p, n in ends.items()}, alpha)


def merge_states(children: dict[int, dict[str, list]], visits: dict[int, int],
                 stops: dict[int, int], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of a tree: state -> class -> [next state, examples].

    States are numbered by length, 0 is the root. They are taken in that order; each is merged
    with the first accepted state it is compatible with, its own parent first, or accepted. A
    state without enough examples to tell is compatible with all. A next state of None is one
    that was not kept: its examples count, and the move stays where it is.
    """
    into: dict[int, int] = {}

    def find(p):
        while p in into:
            p = into[p]
        return p

    def far(n1, f1, n2, f2):
        if not n1 or not n2:
            return False
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def compatible(p, q):
        stack = [(p, q)]
        while stack:
            p, q = map(find, stack.pop())
            kids_p, kids_q = children.get(p, {}), children.get(q, {})
            if p == q or not (kids_p or stops.get(p)) or not (kids_q or stops.get(q)):
                continue
            if far(visits[p], stops.get(p, 0), visits[q], stops.get(q, 0)):
                return False
            for c in kids_p.keys() | kids_q.keys():
                (a, n_a), (b, n_b) = kids_p.get(c, (None, 0)), kids_q.get(c, (None, 0))
                if far(visits[p], n_a, visits[q], n_b):
                    return False
                if a is not None and b is not None:
                    stack.append((a, b))
        return True

    def merge(p, q):
        """Fold the tree below ``q`` into ``p``; the states that took something."""
        stack, taken = [(p, q)], set()
        while stack:
            p, q = map(find, stack.pop())
            if p == q:
                continue
            into[q] = p
            taken.add(p)
            visits[p] += visits[q]
            stops[p] = stops.get(p, 0) + stops.get(q, 0)
            kids = children.setdefault(p, {})
            for c, (child, n) in children.get(q, {}).items():
                if c not in kids:
                    kids[c] = [child, n]
                    continue
                kids[c][1] += n
                if kids[c][0] is None:
                    kids[c][0] = child
                elif child is not None:
                    stack.append((kids[c][0], child))
        return taken

    accepted, known = [0], {0}
    fringe: list[tuple[int, int]] = []  # (state, its parent)

    def reach(p):
        for child, _ in children.get(p, {}).values():
            if child is not None:
                heapq.heappush(fringe, (child, p))

    reach(0)
    while fringe:
        state, parent = heapq.heappop(fringe)
        if state in known or find(state) != state:
            continue
        for other in [parent, *[a for a in accepted if a != parent]]:
            if compatible(other, state):
                for p in merge(other, state) & known:
                    reach(p)
                break
        else:
            accepted.append(state)
            known.add(state)
            reach(state)
    number = {p: i for i, p in enumerate(accepted)}
    moves = {
        number[p]: {c: (number[p if k is None else find(k)], n)
                    for c, (k, n) in children.get(p, {}).items()}
        for p in accepted}
    return Automaton(moves, {number[p]: stops.get(p, 0) for p in accepted},
                     {number[p]: visits[p] for p in accepted})


_MASK = (1 << 64) - 1


def _below(node: int, slot: int) -> int:
    """The 64-bit hash of a prefix that is longer by one class; the empty prefix has 0."""
    h = ((node ^ (slot + 1)) * 0x9E3779B97F4A7C15) & _MASK
    h ^= h >> 32
    return (h * 0xD6E8FEB86659FD93) & _MASK


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _slots(s: str) -> list[int]:
    return [*map(_SLOT_OF.__getitem__, s), len(_SLOTS)]


def _steps(shaped: DataFrame, walk, schema: str) -> DataFrame:
    """Rows of ``walk(kind, shape, n)`` over all shapes, in bounded batches."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def batch_of(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*held), out)], schema=out)

    def run(batches):
        held = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for step in walk(*row):
                    held.append(step)
                    if len(held) == 1 << 16:
                        yield batch_of(held)
                        held = []
        if held:
            yield batch_of(held)

    return frames.map_batches(shaped.select("kind", "s", "n"), run, schema)


def _tree_steps(kind: int, s: str, n: int):
    """(kind, prefix, what comes next, examples) for all prefixes of a shape, itself included."""
    node = 0
    for slot in _slots(s):
        yield kind, _signed(node), slot, n
        node = _below(node, slot)


def _per_state(steps: DataFrame) -> DataFrame:
    """kind, state, n and the counts of every slot, n0 to n11."""
    return steps.groupBy("kind", "state").agg(F.sum("n").alias("n"), *[
        F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(0)).alias(f"n{i}")
        for i in range(len(_SLOTS) + 1)])


def _kept_tree(rows) -> tuple[dict, dict, dict]:
    """Children, visits and stops of the states in ``rows``, numbered by length, then string."""
    counts = {r.state & _MASK: r for r in rows}
    slots = sorted(_SLOT_OF.items())
    children, visits, stops, level, number = {}, {}, {}, [(0, 0)], 1
    while level:
        ahead = []
        for i, node in level:
            r = counts[node]
            visits[i], stops[i] = r.n, r[f"n{len(_SLOTS)}"]
            for c, slot in slots:
                if not r[f"n{slot}"]:
                    continue
                child = _below(node, slot)
                if child in counts:
                    ahead.append((number, child))
                    number += 1
                children.setdefault(i, {})[c] = [
                    ahead[-1][0] if child in counts else None, r[f"n{slot}"]]
        level = ahead
    return children, visits, stops


def _counted_anew(shaped: DataFrame, automata: dict[int, Automaton]) -> dict[int, Automaton]:
    """The same automata with the moves and ends of all whole examples counted."""
    targets = {k: {q: {c: to for c, (to, _) in cs.items()} for q, cs in a.moves.items()}
               for k, a in automata.items()}

    def walk(kind, s, n):
        state, moves = 0, targets[kind]
        for c, slot in zip([*s, None], _slots(s)):
            yield kind, state, slot, n
            state = moves.get(state, {}).get(c, state)

    rows = _per_state(_steps(shaped, walk, "kind int, state long, slot int, n long")).collect()
    out = {k: Automaton({}, {}, {}) for k in automata}
    for r in rows:
        a, old = out[r.kind], targets[r.kind].get(r.state, {})
        a.visits[r.state], a.ends[r.state] = r.n, r[f"n{len(_SLOTS)}"]
        a.moves[r.state] = {c: (old.get(c, r.state), r[f"n{i}"])
                            for c, i in _SLOT_OF.items() if r[f"n{i}"]}
    return out


def scan(docs: DataFrame) -> DataFrame:
    """The kinds and values of every row's base spans, and the counts of what is outside them."""

    def run(cols):
        out = {k: [] for k in ("kinds", "seen", "plain")}
        for text in cols["text"]:
            text = text or ""
            base = base_spans(text)
            out["kinds"].append([k for _, _, k in base])
            out["seen"].append([value_of(text, *s) for s in base])
            out["plain"].append(_plain(text, disjoint([x[:2] for x in base])))
        return out

    return frames.map_slices(docs.select("text"), run,
                             "kinds array<int>, seen array<string>, plain array<long>")


#: The slot of every byte; the slot after the last stands for what no credential holds.
_BYTE_SLOT = np.full(256, len(_SLOTS), np.int64)
for _c, _i in _SLOT_OF.items():
    _BYTE_SLOT[list(_CLASSES.get(_c, _c).encode())] = _i


def _plain(text: str, spans) -> list[int]:
    """Counts of the pairs of neighbouring slots outside ``spans``."""
    if spans:
        ends = [0, *(e for _, e in spans)]
        text = " ".join(text[e:s] for e, s in zip(ends, [*(s for s, _ in spans), len(text)]))
    slots = _BYTE_SLOT[np.frombuffer(b" " + text.encode() + b" ", np.uint8)]
    size = len(_SLOTS) + 1
    return np.bincount(slots[:-1] * size + slots[1:], minlength=size * size).tolist()


def learn_formats(scanned: DataFrame) -> tuple[dict[str, Automaton], Ordinary]:
    """An automaton per kind, and the model of ordinary text.

    Prefixes are counted over all examples and their whole length. The driver merges the states
    that hold ``LEAST_EXAMPLES``; then all examples run through the merged automaton, so what
    is behind a state that was not kept counts where it is scored: at the state before it.
    """
    values = scanned.select(F.explode(F.arrays_zip("kinds", "seen")).alias("x")).select(
        F.col("x.kinds").alias("kind"), F.col("x.seen").alias("value"))
    # one translate: classes are named by letters themselves, so all must change at once
    source = "".join(cs for cs in _CLASSES.values())
    target = "".join(k * len(cs) for k, cs in _CLASSES.items())
    shaped = values.select("kind", F.translate("value", source, target).alias("s"))
    shaped = shaped.groupBy("kind", "s").agg(F.count("*").alias("n"))
    shaped = written(shaped, "shapes")
    tree = _per_state(_steps(shaped, _tree_steps, "kind int, state long, slot int, n long"))
    rows = tree.where((F.col("n") >= LEAST_EXAMPLES) | (F.col("state") == 0)).collect()
    merged = {kind: merge_states(*_kept_tree([r for r in rows if r.kind == kind]))
              for kind in sorted({r.kind for r in rows})}
    automata = {KINDS[k]: a for k, a in (_counted_anew(shaped, merged) if merged else {}).items()}
    size = (len(_SLOTS) + 1) ** 2
    row = scanned.select(F.coalesce(F.sum(F.size("kinds")), F.lit(0)), *[
        F.coalesce(F.sum(F.get("plain", F.lit(i))), F.lit(0)) for i in range(size)]).first()
    return automata, Ordinary(list(row)[1:], row[0])


def score(value: str, automata: dict[str, Automaton], ordinary: Ordinary) -> tuple[str, float]:
    """The likeliest format, and the log of the odds that the value is of it rather than ordinary:
    the ratio of the likelihoods times how many credentials there are for each ordinary run."""
    shaped = shape(value)
    best = max(((a.log_likelihood(shaped), k) for k, a in automata.items()), default=(-math.inf, ""))
    return best[1], best[0] - ordinary.log_likelihood(shaped) + ordinary.prior


LIKE = tuple(f"like_{k}" for k in KINDS)
#: Log of the odds (99 to 1) from which a candidate is a secret.
LEAST = math.log(99)


class Judge:
    """Tells secrets among candidates; keeps the verdicts on a bounded number of shapes."""

    def __init__(self, automata, ordinary, least: float = LEAST, limit: int = 100_000):
        self.automata, self.ordinary, self.least, self.limit = automata, ordinary, least, limit
        self.seen: dict[str, int] = {}

    def _kind(self, shaped: str) -> int:
        kind, odds = score(shaped, self.automata, self.ordinary)  # a shape is its own shape
        return len(KINDS) + KINDS.index(kind) if odds >= self.least else -1

    def spans(self, text: str, found) -> list[tuple[int, int, int]]:
        """(start, end, kind) of the candidates that look like a credential; kinds follow ``KINDS``."""
        out, seen = [], self.seen
        for s, e in found:
            shaped = text[s:e].translate(_CLASS_OF)
            kind = seen.get(shaped)
            if kind is None:
                if len(seen) >= self.limit:
                    seen.clear()
                kind = seen[shaped] = self._kind(shaped)
            if kind >= 0:
                out.append((s, e, kind))
        return out


def joined(spans) -> str:
    names = KINDS + LIKE
    return ",".join(f"{names[k]}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and starts, ends, kinds (arrays).

    Base spans are always there; a candidate whose log odds are ``least`` or more is
    added as ``like_<kind>``. Spans are listed by start, then kind; offsets are code points, end
    exclusive. A null or empty text has no span; repeated rows are answered again; a null doc_id
    stays null; an empty table gives no rows; other columns of ``docs`` are ignored. Without any
    labelled credential there is no format, and only base spans are returned.
    """
    judge = Judge(*learn_formats(written(scan(docs), "secrets")), least)
    names = KINDS + LIKE

    def run(cols):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "starts",
                               "ends", "kinds")}
        for text in cols["text"]:
            text = text or ""
            base = base_spans(text)
            for i, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(x[2] == i for x in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans = sorted(base + judge.spans(text, candidates(text, base)), key=lambda x: (x[0], x[2]))
            out["spans"].append(joined(spans))
            out["starts"].append([x[0] for x in spans])
            out["ends"].append([x[1] for x in spans])
            out["kinds"].append([names[x[2]] for x in spans])
        return {"doc_id": cols["doc_id"], **out}

    return frames.map_slices(
        docs.select("doc_id", "text"), run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "starts array<int>, ends array<int>, kinds array<string>")


def redact_text(text: str, judge: Judge, mark: str = "[secret]") -> str:
    """The text with every credential replaced by ``mark``; names of assignments stay."""
    base = base_spans(text)
    values = [(e - len(value_of(text, s, e, k)), e) for s, e, k in base]
    values += [x[:2] for x in judge.spans(text, candidates(text, base))]
    for s, e in reversed(disjoint(values)):
        text = text[:s] + mark + text[e:]
    return text


def redact(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """All rows and columns of ``docs``, with credentials in ``text`` replaced and ``n_chars``,
    if there is such a column, counted anew where the text changed. Formats are learned from all
    rows first."""
    judge = Judge(*learn_formats(written(scan(docs), "secrets")), least)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for part in frames.slices(batch):
                names = part.schema.names
                old = part.column(names.index("text")).to_pylist()
                new = [t and redact_text(t, judge) for t in old]
                cols = list(part.columns)
                cols[names.index("text")] = pa.array(new, type=part.schema.field("text").type)
                if "n_chars" in names:
                    i = names.index("n_chars")
                    counts = [n if a == b else len(b) for n, a, b in zip(cols[i].to_pylist(), old, new)]
                    cols[i] = pa.array(counts, type=part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return frames.map_batches(docs, run, schema)


def op8_secret_formats(spark, sf: str) -> DataFrame:
    return find_secrets(frames.documents(spark, sf)).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
