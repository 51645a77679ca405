"""Token counts by a compiled finite-state tokenizer.

The vocabulary's merges are compiled to a deterministic transducer over characters. The tokens
of a prefix of a text end in one certain token, and a token may follow another exactly if the
merges make these two of the pair's own characters, that is, if no merge of pieces at the edge
between them comes first. So what decides how a text goes on is, for each suffix of what has
been read that some piece of the vocabulary goes on from, the number of tokens since the one
before it, and which pieces that one has at its edge until which merge: that is a state. A
transition on a character finds the token that now is the last one, and is annotated with the
tokens that this emits: more than none if one is added, less if several become one. States are
compiled when a text first reaches them; their number is bounded by the vocabulary.

A text is run through it in chunks. A chunk maps the states that it may begin in to the state
it ends in and the tokens emitted; its possible beginnings are those that the characters before
it lead to, from each of as many places as the longest piece is long. Maps compose
associatively, so a long text's chunks are mapped in different tasks and combined by a tree of
groups. A text whose chunks do not meet in one of these states is run in one piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import cut, kept, slices, tokenizer_file

PIECES = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters of a chunk, and of the text before it that its possible beginnings are taken from.
CHUNK, CONTEXT = 1 << 14, 64
#: Chunk maps that one group composes.
FAN = 64
#: A worker forgets its states when it has compiled so many transitions.
MOST_TRANSITIONS = 300_000
SPACE = "▁"

#: A piece at a token's edge, the score of the merge that makes it, and of the one that ends it.
Edge = tuple[str, float, float]
#: A suffix that some piece goes on from, the edge before it, and the tokens since.
Entry = tuple[str, tuple[Edge, ...], int]


class State(dict):
    """Transitions by character: the next state and the tokens emitted; compiled when first asked for."""

    __slots__ = ("entries", "owner")

    def __init__(self, owner: Transducer, entries: tuple[Entry, ...]) -> None:
        super().__init__()
        self.owner, self.entries = owner, entries

    def __missing__(self, character: str) -> tuple[State, int]:
        found = self[character] = self.owner.transition(self, SPACE if character == " " else character)
        return found


class Transducer:
    """Tokens as the vocabulary's own library makes them: an initial space, no other normalization."""

    def __init__(self, path: str, most: int = MOST_TRANSITIONS) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in usual}
        crossing = [p for p in self.scores if SPACE in p.lstrip(SPACE)]
        if crossing:
            raise ValueError(f"pieces hold a space after another character: {crossing[:3]}")
        #: for each proper prefix of pieces, by left-edge piece: whether all of them have it, the scores that make it at best
        #: and at worst, and those that end it at best and at worst
        self.open: dict[str, dict[str, tuple[bool, float, float, float, float]]] = {}
        #: by left part and first character of the right part: the pieces' scores, best first, and right parts
        self.parts: dict[tuple[str, str], list[tuple[float, str]]] = {}
        self.edges: dict[str, tuple[tuple[Edge, ...], tuple[Edge, ...]] | None] = {}
        going_on: dict[str, list[tuple[Edge, ...]]] = {}
        for piece in sorted(self.scores, key=lambda p: -self.scores[p]):
            own = self.edges_of(piece)
            for k in range(1, len(piece)):
                self.parts.setdefault((piece[:k], piece[k]), []).append((self.scores[piece], piece[k:]))
                if own:
                    going_on.setdefault(piece[:k], []).append(own[0])
        for prefix, lefts in going_on.items():
            of: dict[str, list[Edge]] = {}
            for left in lefts:
                for edge in left:
                    of.setdefault(edge[0], []).append(edge)
            self.open[prefix] = {y: (len(e) == len(lefts), max(x[1] for x in e), min(x[1] for x in e), max(x[2] for x in e), min(x[2] for x in e)) for y, e in of.items()}
        self.longest = max(map(len, self.scores))
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple[Entry, ...], State] = {}
        self.meetings: dict[tuple[tuple[Edge, ...], str], tuple[Edge, ...] | None] = {}
        self.compiled = 0
        self.root = self.state((("", (), 0),))

    def state(self, entries: tuple[Entry, ...]) -> State:
        found = self.states.get(entries)
        if found is None:
            found = self.states[entries] = State(self, entries)
        return found

    def edges_of(self, token: str) -> tuple[tuple[Edge, ...], tuple[Edge, ...]] | None:
        """The pieces at the left and the right edge while ``token`` is merged; None if its characters make others.

        The best-scored pair merges first, the leftmost of equals. A piece that a better merge
        had to wait for counts from the worst score so far on.
        """
        if token in self.edges:
            return self.edges[token]
        parts, score = list(token), self.scores.get
        left, right, worst = [(parts[0], inf)], [(parts[-1], inf)], inf
        pairs = [score(a + b, -inf) for a, b in pairwise(parts)]
        while pairs and (best := max(pairs)) > -inf:
            at, worst = pairs.index(best), min(worst, best)
            new = parts[at] = parts[at] + parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + new, -inf)
            else:
                left.append((new, worst))
            if at < len(pairs):
                pairs[at] = score(new + parts[at + 1], -inf)
            else:
                right.append((new, worst))
        lasting = lambda x: tuple((p, made, ended) for (p, made), (_, ended) in pairwise([*x, ("", -inf)]))
        found = self.edges[token] = (lasting(left), lasting(right)) if len(parts) == 1 else None
        return found

    def may_follow(self, edge: tuple[Edge, ...], token: str) -> bool:
        """Whether ``token`` stays as it is behind a token with this edge.

        It does not if pieces of both edges are there at once, and their merge comes before the
        one that ends either; of equal scores the left merge comes first.
        """
        own = self.edges_of(token)
        if own is None:
            return False
        for x, x_made, x_ended in edge:
            for y, y_made, y_ended in own[0]:
                s = self.scores.get(x + y)
                if s is not None and s > x_ended and y_made > x_ended and s >= y_ended and x_made >= y_ended:
                    return False
        return True

    def met(self, edge: tuple[Edge, ...], suffix: str) -> tuple[Edge, ...] | None:
        """The pieces of an edge that may merge with what goes on from ``suffix``; None if one does in any case."""
        if (edge, suffix) in self.meetings:
            return self.meetings[edge, suffix]
        kept, lefts = [], self.open[suffix]
        for x, made, ended in edge:
            met = False
            for s, y in self.parts.get((x, suffix[0]), ()):
                if s <= ended:
                    break
                left = lefts.get(y)
                if left and left[1] > ended and min(s, made) >= left[4]:
                    if left[0] and left[2] > ended and min(s, made) >= left[3]:
                        self.meetings[edge, suffix] = None
                        return None
                    met = True
            if met:
                kept.append((x, made, ended))
        found = self.meetings[edge, suffix] = tuple(kept)
        return found

    def transition(self, state: State, character: str) -> tuple[State, int]:
        self.compiled += 1
        if self.compiled > self.most:
            self.forget()
        for suffix, edge, since in state.entries:
            token = suffix + character
            if (len(token) == 1 or token in self.scores) and self.may_follow(edge, token):
                break
        # a character that the vocabulary lacks falls back to its bytes
        emitted = (1 if token in self.scores else len(token.encode("utf-8", "surrogatepass"))) - since
        going_on = [(t, met, n + emitted) for s, edge, n in state.entries if (t := s + character) in self.open and (met := self.met(edge, t)) is not None]
        return self.state((*going_on, ("", self.edges_of(token)[1], 0))), emitted

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after ``text``, and the tokens emitted."""
        total = 0
        for character in text:
            state, emitted = state[character]
            total += emitted
        return state, total

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; none for a null or empty one."""
        return self.run(self.root, SPACE + text)[1] if text else 0

    def chunk_map(self, context: str, chunk: str, first: bool) -> dict[str, tuple[str, int]]:
        """From each state that the chunk may begin in: the state it ends in and the tokens emitted."""
        if first:
            starts = {self.name(self.root): self.root}
            chunk = SPACE + chunk
        else:
            reached = [self.run(self.root, context[k:])[0] for k in range(min(self.longest, len(context)))]
            starts = {self.name(s): s for s in reached}
        now = {name: (s, 0) for name, s in starts.items()}
        for at in range(0, len(chunk), 512):
            part, done = chunk[at : at + 512], {}
            for state, _ in now.values():
                if state.entries not in done:
                    done[state.entries] = self.run(state, part)
            now = {name: (done[s.entries][0], n + done[s.entries][1]) for name, (s, n) in now.items()}
        return {name: (self.name(s), n) for name, (s, n) in now.items()}

    @staticmethod
    def name(state: State) -> str:
        """A state as text, the same in all workers."""
        return json.dumps(state.entries, separators=(",", ":"))


def transducer(folder: str | None) -> Transducer:
    """The worker's transducer, kept until another operator's task runs in the worker."""
    return kept(Transducer, tokenizer_file(PIECES, folder))


def _composed(maps: Column) -> Column:
    """The map of several chunks in a row, from (chunk, states) of each; a way that breaks off is left out."""
    then = lambda a, b: F.map_filter(
        F.transform_values(a, lambda _, v: F.struct(F.try_element_at(b, v["end"])["end"].alias("end"), (v["n"] + F.try_element_at(b, v["end"])["n"]).alias("n"))),
        lambda _, v: v["end"].isNotNull(),
    )
    ordered = F.transform(F.array_sort(maps, lambda a, b: (a["chunk"] - b["chunk"]).cast("int")), lambda x: x["states"])
    return F.reduce(F.slice(ordered, 2, FAN), F.element_at(ordered, 1), then)


_MAP = "map<string, struct<end: string, n: long>>"


def count_tokens(docs: DataFrame, folder: str | None = None, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; a null text counts as empty.

    Special strings inside texts are ordinary text. Repeated rows are each counted; an empty
    table gives an empty result. Columns beyond doc_id and text are ignored whatever their
    names. A text of more than ``chunk`` characters is counted by several tasks, however long
    it is. ``folder`` holds the vocabulary.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(folder)
        for batch in slices(batches, keeping=Transducer):
            counts = pa.array(map(own.count, batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["doc_id", "n_bytes", "n_tokens"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, keeping=Transducer):
            for row, doc_id, size, text in zip(*(c.to_pylist() for c in batch.columns)):
                places, before = range(0, len(text), chunk), SPACE + text
                values = ([row] * len(places), [doc_id] * len(places), [size] * len(places), list(range(len(places))), [before[max(a + 1 - CONTEXT, 0) : a + 1] for a in places], [text[a : a + chunk] for a in places])
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=["row", "doc_id", "n_bytes", "chunk", "context", "part"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(folder)
        kind = pa.map_(pa.string(), pa.struct([("end", pa.string()), ("n", pa.int64())]))
        for batch in slices(batches, keeping=Transducer):
            found = [own.chunk_map(c, p, k == 0) for k, c, p in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)))]
            states = pa.array([[(name, {"end": end, "n": n}) for name, (end, n) in f.items()] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], states], names=["row", "doc_id", "n_bytes", "chunk", "states"])

    def in_one_piece(table: pa.Table) -> pa.Table:
        own = transducer(folder)
        state, total = own.run(own.root, SPACE)
        for part in table.sort_by("chunk").column("part").to_pylist():
            state, n = own.run(state, part)
            total += n
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "n_bytes": table.column("n_bytes").slice(0, 1), "n_tokens": pa.array([total], pa.int64())})

    counted = "doc_id long, n_bytes long, n_tokens long"
    is_long = F.char_length("text") > chunk
    whole = rows.where(~is_long).select("doc_id", n_bytes, "text").mapInArrow(short, counted)
    numbered = rows.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", n_bytes, "text")
    parts = cut(numbered.mapInArrow(chunks, "row long, doc_id long, n_bytes long, chunk long, context string, part string"), "chunks")
    level = cut(parts.repartition("row", "chunk").mapInArrow(maps, f"row long, doc_id long, n_bytes long, chunk long, states {_MAP}"), "chunk-maps")
    # three levels compose 2**18 chunks, more than the longest string has
    for _ in range(3):
        group = level.groupBy("row", F.expr(f"chunk div {FAN}").alias("chunk"))
        level = group.agg(F.min("doc_id").alias("doc_id"), F.min("n_bytes").alias("n_bytes"), _composed(F.collect_list(F.struct("chunk", "states"))).alias("states"))
    composed = cut(level.select("row", "doc_id", "n_bytes", F.get(F.map_values("states"), F.lit(0))["n"].alias("n_tokens")), "composed")
    out = whole.union(composed.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens"))
    broken = composed.where("n_tokens is null").select("row")
    if not broken.isEmpty():
        # a group is one text
        out = out.union(parts.join(broken, "row", "left_semi").groupBy("row").applyInArrow(in_one_piece, counted))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
