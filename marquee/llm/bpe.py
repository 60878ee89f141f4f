"""Byte-level BPE by recursive DuckDB queries inside the tasks: encoding and decoding by a file of ranks.

A text is cut into the matches of a pattern, each encoded on its own. A match that is a token is that token. Any other starts as one
row per byte (word, position, id and its right neighbour); a recursive query joins them with the merge table, contracts each word's
leftmost pair of minimum rank, and goes on with the words that changed until none does. Decoding joins ids with the vocabulary
and aggregates their bytes in order.

Words of `LONG` bytes and more would take a round per pair. There a round contracts all pairs that are sure to be contracted anyhow: the
bytes that stand left and right of a pair are known, so the ranks of all tokens that could ever reach over its ends have a least one; a
pair whose rank is not above these, nor the least one over the new token's ends below it, commutes with all others. Of pairs of one rank
side by side every other one is taken, from the left. Words without such a pair contract those of minimum rank, from the left up to the
first whose new token might take part in a pair of lower rank.

Spark partitions the documents; nothing is shuffled. A task looks at about `SLICE` characters (or one longer text) and
about `CHUNK` bytes of unknown matches (or one longer match) at a time, and remembers matches and their ids up to `REMEMBERED` bytes.
"""

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marquee.llm.common import LATIN, Remembered, per_process, with_classes

REMEMBERED = 96 << 20
SLICE = 1 << 21
CHUNK = 1 << 16
#: Bytes from which on a match contracts all sure pairs of a round.
LONG = 128
#: Ids that are decoded at a time.
IDS = 1 << 19
#: Memory of a worker's DuckDB in MB, and bytes more of it for each byte of a match longer than `CHUNK`.
MEMORY, MORE = 160, 1000

#: All white space, as the pattern's library sees it.
SPACES = r"\t\n\x0b\x0c\r \x85\p{Zs}\p{Zl}\p{Zp}"

MERGED = """
WITH RECURSIVE state(w, pos, id, next_id, next_pos, live) AS (
    SELECT w, pos, id, lead(id) OVER neighbours, lead(pos) OVER neighbours, true
    FROM bytes_in WINDOW neighbours AS (PARTITION BY w ORDER BY pos)
    UNION ALL
    (WITH best AS (
        SELECT w, min(rank << 32 | pos) AS found, arg_min(next_pos, rank << 32 | pos) AS gone
        FROM state JOIN merges ON state.id = merges.a AND state.next_id = merges.b WHERE live GROUP BY w),
    met AS (
        SELECT best.w, found & 4294967295 AS pos, (found >> 32)::INTEGER AS id, gone, g.next_id AS after_id, g.next_pos AS after_pos
        FROM best JOIN state g ON g.w = best.w AND g.pos = best.gone WHERE g.live)
    SELECT s.w, s.pos, CASE WHEN s.pos = m.pos THEN m.id ELSE s.id END,
           CASE WHEN s.pos = m.pos THEN m.after_id WHEN s.next_pos = m.pos THEN m.id ELSE s.next_id END,
           CASE WHEN s.pos = m.pos THEN m.after_pos ELSE s.next_pos END, m.w IS NOT NULL
    FROM state s LEFT JOIN met m ON s.w = m.w WHERE s.live AND (gone IS NULL OR s.pos <> gone))
)
SELECT w, list(id ORDER BY pos) AS ids FROM state WHERE NOT live GROUP BY w
"""

#: As MERGED, with every sure pair of a round. What is no rank counts as 2147483647.
MERGED_LONG = """
WITH RECURSIVE state(w, pos, id, live) AS (
    SELECT w, pos, id, true FROM bytes_in
    UNION ALL
    (WITH near AS (
        SELECT w, pos, id, lag(id) OVER o AS before, lead(id) OVER o AS after, lead(id, 2) OVER o AS beyond, row_number() OVER o AS n
        FROM state WHERE live WINDOW o AS (PARTITION BY w ORDER BY pos)),
    met AS (
        SELECT near.w, pos, near.id, n, rank, coalesce(l.least, 2147483647) > rank AS begins,
               coalesce(coalesce(ll.least, 2147483647) > rank AND coalesce(rr.least, 2147483647) > rank, false) AS calm,
               calm AND coalesce(l.least, 2147483647) >= rank AND coalesce(r.least, 2147483647) >= rank AS sure,
               coalesce(rank = min(rank) OVER (PARTITION BY near.w), false) AS lowest
        FROM near LEFT JOIN merges m ON near.id = m.a AND near.after = m.b
        LEFT JOIN vocabulary p ON p.id = near.before LEFT JOIN over_left l ON l.last = p.last AND l.b = near.id
        LEFT JOIN over_left ll ON ll.last = p.last AND ll.b = rank LEFT JOIN vocabulary q ON q.id = near.beyond
        LEFT JOIN over_right r ON r.a = near.after AND r.first = q.first LEFT JOIN over_right rr ON rr.a = rank AND rr.first = q.first),
    runs AS (
        SELECT *, n - row_number() OVER (PARTITION BY w, sure ORDER BY n) AS run, n - row_number() OVER (PARTITION BY w, lowest ORDER BY n) AS low_run FROM met),
    taken AS (
        SELECT w, pos, id, n, rank, calm, sure AND first_value(begins) OVER g AND row_number() OVER g % 2 = 1 AS taken,
               lowest AND row_number() OVER h % 2 = 1 AS next
        FROM runs WINDOW g AS (PARTITION BY w, sure, run ORDER BY n), h AS (PARTITION BY w, lowest, low_run ORDER BY n)),
    words AS (
        SELECT w, bool_or(taken) AS sure_ones, min(n) FILTER (next) AS one, min(n) FILTER (next AND NOT calm) AS wild FROM taken GROUP BY w),
    now AS (
        SELECT t.w, pos, id, n, rank, taken OR (NOT sure_ones AND next AND (n = one OR n < coalesce(wild, n + 1))) AS now, one IS NOT NULL AS live
        FROM taken t JOIN words USING (w)),
    left_over AS (SELECT *, lag(now) OVER (PARTITION BY w ORDER BY n) AS gone FROM now)
    SELECT w, pos, CASE WHEN now THEN rank::INTEGER ELSE id END, live FROM left_over WHERE NOT coalesce(gone, false))
)
SELECT w, list(id ORDER BY pos) AS ids FROM state WHERE NOT live GROUP BY w
"""

DECODED = "SELECT d, list(bytes ORDER BY pos) AS bytes FROM ids_in JOIN vocabulary USING (id) GROUP BY d"


#: The least ranks that reach over a token's ends, by the byte there.
PREPARED = """
CREATE TABLE over_left AS SELECT last, b, min(rank) AS least FROM merges JOIN vocabulary ON id = a GROUP BY ALL;
CREATE TABLE over_right AS SELECT a, first, min(rank) AS least FROM merges JOIN vocabulary ON id = b GROUP BY ALL
"""


class Ranks:
    """The vocabulary and its merge table in an in-memory DuckDB of this worker."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(with_classes(pattern, {r"\s": SPACES}))
        self.latin = re.compile(with_classes(pattern, LATIN))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.known = Remembered(REMEMBERED)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
        merges = np.fromiter((x for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
                              for x in (self.ranks[t[:i]], self.ranks[t[i:]], r)), np.int64).reshape(-1, 3)
        self._load("merges", {"a": merges[:, 0].astype(np.int32), "b": merges[:, 1].astype(np.int32), "rank": merges[:, 2].copy()})
        self._load("vocabulary", {"id": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks, pa.binary()),
                                  "first": pa.array([t[0] for t in self.ranks], pa.int32()), "last": pa.array([t[-1] for t in self.ranks], pa.int32())})
        self.db.execute(PREPARED)

    def _load(self, name: str, columns: dict[str, pa.Array | np.ndarray]) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, sql: str, name: str, columns: dict[str, np.ndarray]) -> pa.Table:
        self.db.register(name, pa.table(columns))
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def _contract(self, words: list[bytes], sql: str = MERGED) -> Iterator[tuple[int, np.ndarray]]:
        lengths = np.array([len(w) for w in words])
        starts = np.cumsum(lengths) - lengths
        out = self._query(sql, "bytes_in", {
            "w": np.repeat(np.arange(len(words), dtype=np.int32), lengths),
            "pos": np.arange(lengths.sum()) - np.repeat(starts, lengths),
            "id": self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]})
        ids = out.column("ids").combine_chunks()
        flat, offsets = ids.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
        for w, a, b in zip(out.column("w").to_pylist(), offsets[:-1], offsets[1:]):
            yield w, flat[a:b]

    def _learn(self, words: list[str]) -> None:
        short, long = [], []
        for word in words:
            data = word.encode()
            if data in self.ranks:
                self.known.put(word, self.ranks[data].to_bytes(4, "little"))
            else:
                (long if len(data) >= LONG else short).append((len(data), word, data))
        for rest, sql in ((short, MERGED), (long, MERGED_LONG)):
            for some in _slices(rest, CHUNK, lambda x: x[0]):
                size = sum(x[0] for x in some)
                if size > 2 * CHUNK:
                    self.db.execute(f"SET memory_limit = '{MEMORY + size * MORE // 1_000_000}MB'")
                for w, ids in self._contract([data for _, _, data in some], sql):
                    self.known.put(some[w][1], ids.tobytes())
                if size > 2 * CHUNK:
                    self.db.execute(f"SET memory_limit = '{MEMORY}MB'")

    def split(self, text: str) -> list[str]:
        """The matches of the pattern; in texts without characters beyond U+00FF by plain classes, which is faster."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return self.latin.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian u4 bytes."""
        return self.known.joined([self.split(t) for t in texts], self._learn)

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes that each list of ids stands for."""
        out: list[list[bytes]] = [[] for _ in encoded]
        pieces = ((len(e[at:at + 4 * IDS]) // 4, d, e[at:at + 4 * IDS]) for d, e in enumerate(encoded) for at in range(0, len(e), 4 * IDS))
        for some in _slices(pieces, IDS, lambda x: x[0]):
            for (_, d, _), data in zip(some, self._decoded([ids for _, _, ids in some])):
                out[d].append(data)
        return [b"".join(x) for x in out]

    def _decoded(self, pieces: list[bytes]) -> list[bytes]:
        lengths = np.array([len(e) // 4 for e in pieces])
        found = self._query(DECODED, "ids_in", {
            "d": np.repeat(np.arange(len(pieces), dtype=np.int32), lengths), "pos": np.arange(lengths.sum()),
            "id": np.frombuffer(b"".join(pieces), "<u4").astype(np.int32)})
        out = [b""] * len(pieces)
        tokens = found.column("bytes").combine_chunks()
        flat = tokens.flatten()
        _, starts, data = flat.buffers()
        starts = np.frombuffer(starts, "<i4")[flat.offset:]
        ends = np.cumsum(tokens.value_lengths().to_numpy())
        for d, a, b in zip(found.column("d").to_pylist(), starts[np.concatenate([[0], ends[:-1]])].tolist(), starts[ends].tolist()):
            out[d] = data[a:b].to_pybytes()
        return out


def _slices(rows, size, weight=lambda row: len(row[1])) -> Iterator[list]:
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += weight(row)
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def _mapped(df: DataFrame, value: str, schema: str, ranks: str, pattern: str, make) -> DataFrame:
    """`make(worker, ids, values)` gives the columns of a slice of rows; nulls come as empty."""
    text = df.schema[value].dataType.simpleString() == "string"

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = per_process(("ranks", ranks, pattern), lambda: Ranks(ranks, pattern))
        for batch in batches:
            rows = ((k.as_py(), v.as_py() or ("" if text else b"")) for k, v in zip(batch.column(0), batch.column(1)))
            for some in _slices(rows, SLICE):
                keys, values = zip(*some)
                columns = {"doc_id": pa.array(keys, pa.int64())} | make(worker, list(values))
                yield pa.RecordBatch.from_pydict(columns)

    return df.selectExpr("CAST(doc_id AS LONG) AS doc_id", value).mapInArrow(mapped, schema)


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian u4 bytes) of every row's text. A null or empty text has no ids; repeated rows and null
    doc_ids stay; an empty table gives no rows; other columns are not read."""
    def made(worker, texts):
        ids = worker.encode(texts)
        return {"n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}

    return _mapped(docs, "text", "doc_id LONG, n_tokens LONG, ids BINARY", ranks, pattern, made)


def decode(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and bytes of every row of ids. Null or no ids: no bytes."""
    return _mapped(tokens, "ids", "doc_id LONG, bytes BINARY", ranks, pattern,
                   lambda worker, ids: {"bytes": pa.array(worker.decode(ids), pa.binary())})


def round_trip(docs: DataFrame, ranks: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, and same (the decoded bytes are the text's); with
    `keep_ids` the ids as well."""
    from hashlib import sha256

    def made(worker, texts):
        ids = worker.encode(texts)
        back = worker.decode(ids)
        return {"n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                "ids_sha256": [sha256(i).hexdigest() for i in ids], "decoded_sha256": [sha256(b).hexdigest() for b in back],
                "same": [b == t.encode() for b, t in zip(back, texts)]} | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {})

    schema = "doc_id LONG, n_tokens LONG, ids_sha256 STRING, decoded_sha256 STRING, same BOOLEAN" + ", ids BINARY" * keep_ids
    return _mapped(docs, "text", schema, ranks, pattern, made)
