"""Runs of repeated words (maximal periodicities) by the method of Kolpakov and Kucherov, and texts collapsed by them.

A run is a stretch of consecutive words whose smallest period is q (words q apart are the same), that is at least `least` words
and `times` periods long, and that no neighbouring word extends keeping the period. For each text:

1. A suffix automaton over the words, with the first end of every state, gives the LZ factors: each is the longest stretch that
   also starts earlier (overlap allowed), or a word that is new.
2. At each boundary of factors Main's extensions (longest common prefixes and suffixes with the words q away, by Z-functions)
   give the runs that touch it. A factor that starts a period or more inside a run goes to the run's end, so at the last
   boundary before a run's end the run reaches no further than the factor ahead, and a period beyond the factor behind: the
   extensions are as long as these factors, and boundaries between factors too short for `least` words are passed over.
3. Every other run lies strictly inside a factor and is copied from the factor's earlier occurrence, in ascending order of starts.

Each word of a run occurs `times` times or more in it, so a text is cut first at words that occur less often in it. Memory is
linear in one text, and texts pass in Arrow batches of bounded size; nothing is shuffled.

Null, empty and blank texts have no words and no runs and collapse to the empty text. Repeated rows and null keys give a row
each; other columns don't pass, so their names can't clash.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from chronoplate.llm.common import arrow_map

LEAST, TIMES = 24, 3


def automaton(t: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions of the suffix automaton of t, and for each state the first place where its strings end."""
    go: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(t):
        new = len(go)
        go.append({})
        length.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                half = len(go)
                go.append(go[q].copy())
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = half
                    p = link[p]
                link[q] = link[new] = half
        last = new
    return go, first


def factors(t: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, first occurrence's start) of the LZ factors of t; a new symbol is a factor of its own with no occurrence (-1)."""
    go, first = automaton(t)
    out, p, n = [], 0, len(t)
    while p < n:
        state, i = 0, p
        while i < n and first[to := go[state][t[i]]] < i:
            state = to
            i += 1
        if i == p:
            out.append((p, 1, -1))
            p += 1
        else:
            out.append((p, i - p, first[state] - (i - p) + 1))
            p = i
    return out


def z_function(s: list[int]) -> list[int]:
    """For each place of s the length of the longest common prefix of s and its suffix there."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def touching(t: list[int], x: int, behind: int, ahead: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of runs that contain or touch the boundary x and go on at most `ahead` words after it and `behind` and a period before it. Periods needn't be the smallest."""
    longest = (ahead + behind) // (times - 1)
    lo, hi = max(0, x - behind - longest - 1), min(len(t), x + ahead + 1)
    right, left = t[x:hi], t[lo:x][::-1]
    from_x, to_x = max(lo, x - longest), min(hi, x + longest)
    z_right, z_left = z_function(right), z_function(left)
    z_back = z_function([*right, -1, *t[from_x:hi]])
    z_on = z_function([*left, -1, *t[lo:to_x][::-1]])
    found = []
    for q in range(1, longest + 1):
        enough = max(least, times * q)
        if x - q >= from_x:  # a period or more lies before x
            s = x - q - (z_left[q] if q < len(left) else 0)
            e = x + z_back[len(right) + 1 + x - q - from_x]
            if e - s >= enough and (s > lo or not lo) and (e < hi or hi == len(t)):
                found.append((s, e, q))
        if x + q <= to_x:  # a period or more lies after x
            s = x - z_on[len(left) + 1 + to_x - x - q]
            e = x + q + (z_right[q] if q < len(right) else 0)
            if e - s >= enough and (s > lo or not lo) and (e < hi or hi == len(t)):
                found.append((s, e, q))
    return found


def runs_of(t: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, period, length) of all runs of a list of symbols (not negative), in ascending order."""
    by_start: dict[int, dict[int, int]] = {}

    def add(s: int, e: int, q: int) -> None:
        ends = by_start.setdefault(s, {})
        ends[e] = min(q, ends.get(e, q))

    behind = 0
    for start, length, source in [*factors(t), (len(t), 0, -1)]:
        if (behind + length) * times >= least * (times - 1):
            for run in touching(t, start, behind, length, least, times):
                add(*run)
        if by_start and source >= 0 and length > least + 1:
            shift, end = start - source, source + length
            for s in range(source + 1, end - least):
                for e, q in by_start.get(s, {}).items():
                    if e < end:
                        add(s + shift, e + shift, q)
        behind = length
    return sorted((s, q, e - s) for s, ends in by_start.items() for e, q in ends.items())


def find(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of words, by start, then period."""
    often = {w: i for i, w in enumerate(w for w, n in Counter(words).items() if n >= times)}
    out: list[tuple[int, int, int]] = []
    piece: list[int] = []
    for i, w in enumerate([*words, None]):
        if w in often:
            piece.append(often[w])
        elif piece:
            if len(piece) >= least:
                out += [(i - len(piece) + s, length, q) for s, q, length in runs_of(piece, least, times)]
            piece = []
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    stay = bytearray(b"\1") * len(words)
    for s, length, q in runs:
        stay[s + q : s + length] = bytes(length - q)
    return b" ".join(w for w, k in zip(words, stay, strict=True) if k)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """`key`, `n_words`, `runs` array<struct<start,length,period>> in ascending order of start and period, and `collapsed` string of every whole text.

    `least` words and `times` (two or more) periods make a run."""
    if times < 2:
        raise ValueError("a run has two periods at least")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, found, kept = [], [], []
        for value in batch.column(1):
            words = (value.as_py() or "").encode().split()  # bytes.split() splits on exactly the six blanks
            runs = find(words, least, times)
            sizes.append(len(words))
            found.append([{"start": s, "length": length, "period": q} for s, length, q in runs])
            kept.append(collapsed(words, runs).decode())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(kept, pa.string())], names=["key", "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return arrow_map(docs.select(docs[key].alias("key"), docs[text].alias("text")), "text", schema, work).withColumnRenamed("key", key)
