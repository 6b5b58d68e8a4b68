"""BPE encoding and decoding with content-defined chunks: chunks that documents share are encoded once, joins are re-encoded."""
from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from provena.llm.common import durable, if_small, small_batches

#: A chunk ends where the top bits of the rolling hash are zero: about every 2**CHUNK_BITS bytes.
CHUNK_BITS = 10
#: Shorter cores are not worth sharing.
CORE_BYTES = 128
#: Shared chunks are broadcast if there are no more than this many; beyond, they are joined with the texts. Results are equal either way.
SHARED_CHUNKS = 200_000
#: References to one chunk are dealt over a salt for each this many of them; its tokens are copied once per salt.
REFERENCES = 64
#: Words kept by a Python worker.
WORDS = 120_000
#: The parts of a tokenizers file that encode words one by one, and decode by joining tokens with spaces.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "decoder": None}
#: Text with only these characters needs no NFC and has one lower case for each character; other text goes through the library whole.
UNUSUAL = re.compile("[^\\x20-\\x7e\\n\\t\\r\xa1-\xac\xae-įı-ſ]|<\\|")

#: A run of letters and the signs that end it: two tokens' worth of text that don't depend on each other.
_ENDED = re.compile(r"([^\W\d_]+)([^\w\s]+)")
_BLANK = re.compile(rb"[\x20\n]")
_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def cores(raw: bytes) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the chunk cores of a text in UTF-8.

    Chunks end where a hash rolling over 16 bytes says so, which depends on content alone. A chunk's core starts at its
    first space or line feed and ends before its last one. Tokens never span white space, so the core's tokens agree with those of the whole
    text; the words around a chunk's end lie in no core and are encoded again with their surroundings.
    """
    a = np.frombuffer(raw, np.uint8)
    if len(a) < 2 * CORE_BYTES:
        return []
    h = _GEAR[a]
    for shift in (1, 2, 4, 8):
        g = h.copy()
        g[shift:] += h[:-shift] << np.uint32(shift)
        h = g
    ends = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    ends = np.unique(np.append(ends, len(a)))
    blank = np.flatnonzero((a == 32) | (a == 10))
    if not len(blank):
        return []
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(blank, starts)
    last = np.searchsorted(blank, ends) - 1
    out = []
    for f, t in zip(first.tolist(), last.tolist()):
        if f < t:
            s, e = int(blank[f]), int(blank[t])
            if e - s >= CORE_BYTES:
                out.append((s, e, hashlib.blake2b(raw[s:e], digest_size=16).digest()))
    return out


def encodes_by_words(path: str) -> bool:
    """Whether a file's parts are BY_WORDS, and its added tokens are ones that UNUSUAL tells."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    return all(file.get(k) == v for k, v in BY_WORDS.items()) and all("<|" in t["content"] for t in file["added_tokens"]) and not file["model"]["unk_token"]


class Encoder:
    """Exact encodings of text by a tokenizers file.

    A file whose parts are BY_WORDS encodes words one by one, so words are looked up in a bounded table and only new ones go through the
    library, many at once with a bar between them. Unusual texts, and every text with another file, go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        bar = self.library.encode("|", add_special_tokens=False).ids
        self.by_words = encodes_by_words(path) and len(bar) == 1
        if self.by_words:
            self.bar = bar[0]
            names = [(self.library.id_to_token(i) or "").encode() + b" " for i in range(self.library.get_vocab_size())]
            self.name_bytes, self.name_at = _packed(names)
            self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.id_at, self.uses = np.empty(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def named(self, ids: np.ndarray) -> bytes:
        """The text that decode() gives for ids."""
        if not self.by_words:
            return self.library.decode(ids.tolist(), skip_special_tokens=False).encode()
        return _gathered(self.name_bytes, self.name_at, ids)[0][:-1].tobytes()

    def _shrink(self) -> None:
        """Keep the half of the words that is used most."""
        words = list(self.index)
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: WORDS // 2])
        self.ids, self.id_at = _gathered(self.ids, self.id_at, kept)
        self.uses = self.uses[kept] // 2
        self.index = {words[k]: i for i, k in enumerate(kept.tolist())}

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n = len(self.index)
        self.index.update(zip(words, range(n, n + len(words))))
        self.id_at = np.append(self.id_at, len(self.ids) + ends)
        self.ids = np.concatenate([self.ids, ids.astype("<u4")])
        self.uses = np.append(self.uses, np.zeros(len(words), np.int64))

    def _ask(self, words: list[str], whole: bool) -> None:
        """Add words without bars from the library. whole: each is one run of letters or of signs, so it needs no splitting but at the bars."""
        if not words:
            return
        if whole:
            from tokenizers import pre_tokenizers
            before = self.library.normalizer, self.library.pre_tokenizer
            self.library.normalizer, self.library.pre_tokenizer = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        codes = self.library.encode_batch_fast([" | ".join([*words[k : k + 512], ""]) for k in range(0, len(words), 512)], add_special_tokens=False)
        if whole:
            self.library.normalizer, self.library.pre_tokenizer = before
        ids = np.concatenate([np.array(e.ids, "<u4") for e in codes])
        bars = np.flatnonzero(ids == self.bar)
        self._add(words, ids[ids != self.bar], bars - np.arange(len(bars)))

    def _learn(self, new: list[str]) -> None:
        whole, odd, barred, made = {}, [], [], []
        for w in new:
            if w.isalpha():
                whole[w] = None
            elif "|" in w:
                barred.append(w)
            elif m := _ENDED.fullmatch(w):
                made.append((w, *m.groups()))
                whole.update((x, None) for x in m.groups() if x not in self.index)
            else:
                odd.append(w)
        odd = [w for w in odd if w not in whole]
        self._ask(list(whole), True)
        self._ask(odd, False)
        if barred:
            codes = [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(barred, add_special_tokens=False)]
            self._add(barred, np.concatenate(codes), np.cumsum([len(c) for c in codes]))
        if made:
            ids, ends = _gathered(self.ids, self.id_at, np.array([self.index[x] for _, *parts in made for x in parts]))
            self._add([w for w, *_ in made], ids, ends[2::2])

    def _by_words(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.index) > WORDS:
            self._shrink()
        words = [w for t in texts for w in t]
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        if len(miss := np.flatnonzero(at < 0)):
            self._learn(list(dict.fromkeys(words[k] for k in miss)))
            at[miss] = [self.index[words[k]] for k in miss]
        self.uses += np.bincount(at, minlength=len(self.uses))
        ids, ends = _gathered(self.ids, self.id_at, at)
        cuts = ends[np.cumsum([len(t) for t in texts])]
        return np.split(ids, cuts[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = [x.lower().split() if self.by_words and not UNUSUAL.search(x) else None for x in texts]
        done = iter(self._by_words([p for p in plain if p is not None]) if any(p is not None for p in plain) else ())
        return [np.array(self.library.encode(x, add_special_tokens=False).ids, "<u4") if p is None else next(done) for x, p in zip(texts, plain)]


def _packed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(x) for x in parts]))


def _gathered(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows `which` of a ragged array (row k is flat[at[k]:at[k + 1]]), as a ragged array."""
    start = at[which]
    size = at[np.asarray(which, np.int64) + 1] - start
    ends = np.append(0, np.cumsum(size))
    return flat[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, of the file that was asked for last."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _slices(batch, column: str, rows: int = 128, size: int = 1 << 20):
    """Slices of a batch of at most so many rows, and bytes of the column if a row has fewer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to


_ROW = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("doc_id", pa.int64()), ("text_md5", pa.binary()), ("pos", pa.int32()), ("fp", pa.binary()), ("salt", pa.int32()), ("ids", pa.binary()),
                  ("head", pa.binary()), ("tail", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_ROW_DDL = "kind string, key long, doc_id long, text_md5 binary, pos int, fp binary, salt int, ids binary, head binary, tail binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
_OUT = ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]


def _short(ids: np.ndarray) -> bytes:
    """Ids as little-endian integers of 16 bits where the vocabulary allows, else of 32; a first byte says which."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def _long(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2", offset=1).astype("<u4") if ids[:1] == b"\x02" else np.frombuffer(ids, "<u4", offset=1)


def _digests(ids: np.ndarray, decoded: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _plan(raw: bytes, doc_id, shared) -> tuple[list, list]:
    """(pieces, owned cores) of a text, given the shared cores {digest: (owner, references)}.

    Pieces are ("ref", digest, first word, last word) of shared cores that another document owns, and ("gap", text, last word before, first word
    after) of what lies between. A gap's text has those two words of its neighbours at its ends, so that their tokens can be compared.
    """
    refs, owned = [], []
    for s, e, fp in cores(raw) if shared else ():
        if fp in shared:
            if shared[fp][0] == doc_id:
                owned.append((fp, raw[s:e].decode()))
            else:
                words = [m.start() for m in _BLANK.finditer(raw, s, e)]
                refs.append((s, e, fp, raw[s : words[1] if len(words) > 1 else e].decode(), raw[words[-1] : e].decode()))
    pieces, done, before = [], 0, ""
    for s, e, fp, first, last in refs:
        pieces += [("gap", before + raw[done:s].decode() + first, before, first), ("ref", fp, first, last)]
        done, before = e, last
    pieces.append(("gap", before + raw[done:].decode(), before, ""))
    return pieces, owned


def _agreed(ids: np.ndarray, head: np.ndarray, tail: np.ndarray) -> bool:
    return len(ids) >= len(head) + len(tail) and (ids[: len(head)] == head).all() and (ids[len(ids) - len(tail) :] == tail).all()


def encode_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", shared_chunks: int = SHARED_CHUNKS, with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids array<int> with with_ids).

    ids and the decoded text equal those of the tokenizers library, without special tokens added. A null text is
    empty: no tokens, digests of nothing. Repeated rows each get a row; other columns are ignored. A file whose parts are not BY_WORDS may let tokens
    depend on text at any distance, so its documents are encoded whole and share no chunks.

    First pass: digests of chunk cores are counted over all documents, pre-aggregated per batch. Second pass: a
    shared core is encoded by the document with its smallest doc_id only; other documents keep a reference. The text
    between references is encoded in place with a word of either neighbour. References are joined with the encoded cores by digest and salt (a
    frequent core has many salts); where the tokens of the words that overlap are the same on both sides the parts are put together, and a document
    in which some differ is encoded again whole. Documents without references are finished at once, so texts are shuffled only if shared chunks
    are too many to broadcast.
    """
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_b"))
    if not encodes_by_words(path):
        return _finish(rows.mapInArrow(_whole(path, with_ids), "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"), with_ids)

    def count(batches):
        for batch in batches:
            for part in _slices(batch, "_b", 4096, 8 << 20):
                seen: dict[bytes, list[int]] = {}
                for i, raw in zip(part.column("doc_id").to_pylist(), part.column("_b").to_pylist()):
                    if i is not None:
                        for _, _, fp in cores(raw):
                            x = seen.setdefault(fp, [0, i])
                            x[0] += 1
                            x[1] = min(x[1], i)
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], ["fp", "n", "owner"])

    seen = durable(rows.mapInArrow(count, "fp binary, n long, owner long").groupBy("fp").agg(F.sum("n").alias("n"), F.min("owner").alias("owner")).where("n > 1"), "bpe-shared")
    few = if_small(seen, shared_chunks)[1]
    if few:
        top = seen.select("fp", "owner", "n").toArrow()  # at most shared_chunks rows
        listed = spark.sparkContext.broadcast(dict(zip(top.column("fp").to_pylist(), zip(top.column("owner").to_pylist(), top.column("n").to_pylist()))))
        known_rows = rows.withColumn("known", F.lit(None).cast("array<struct<fp:binary,owner:long,n:long>>"))
    else:
        listed = None

        def list_cores(batches):
            for batch in batches:
                for part in _slices(batch, "_b"):
                    found = [(k, fp) for k, raw in zip(part.column("text_md5").to_pylist(), part.column("_b").to_pylist()) for fp in {fp for *_, fp in cores(raw)}]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["text_md5", "fp"])

        named = rows.withColumn("text_md5", F.unhex(F.md5("_b")))
        own = named.select("text_md5", "_b").mapInArrow(list_cores, "text_md5 binary, fp binary").distinct()
        own = own.join(seen, "fp").groupBy("text_md5").agg(F.collect_list(F.struct("fp", "owner", "n")).alias("known"))  # the chunks of one text
        known_rows = named.join(own, "text_md5", "left").select("doc_id", "_b", "known")

    def encode(batches):
        enc, base, n = encoder(path), TaskContext.get().partitionId() << 40, 0
        everywhere = listed.value if listed is not None else None
        for batch in batches:
            for part in _slices(batch, "_b"):
                out, plans, texts = [], [], []
                for i, raw, own in zip(part.column("doc_id").to_pylist(), part.column("_b").to_pylist(), part.column("known").to_pylist()):
                    shared = everywhere if everywhere is not None else {x["fp"]: (x["owner"], x["n"]) for x in own or ()}
                    pieces, owned = _plan(raw, i, shared)
                    plans.append((i, raw, shared, pieces, owned))
                    texts += [t for _, t in owned]
                    for kind, *p in pieces:
                        texts += p if kind == "gap" and len(pieces) > 1 else p[:1] if kind == "gap" else p[1:]
                codes = iter(enc.encode(texts))
                for i, raw, shared, pieces, owned in plans:
                    for fp, _ in owned:
                        out.append(("core", None, None, None, None, fp, 1 + shared[fp][1] // REFERENCES, _short(next(codes)), None, None, None, None, None))
                    if len(pieces) == 1:
                        ids = next(codes)
                        out.append(("done", None, i, None, None, None, None, _short(ids) if with_ids else None, None, None, *_digests(ids, enc.named(ids))))
                        continue
                    n += 1
                    name = hashlib.md5(raw).digest()
                    for pos, (kind, what, *_) in enumerate(pieces):
                        if kind == "ref":
                            head, tail = next(codes), next(codes)
                            out.append(("part", base | n, i, name, pos, what, (base + n + pos) % (1 + shared[what][1] // REFERENCES), None, _short(head), _short(tail), None, None, None))
                        else:
                            ids, head, tail = next(codes), next(codes), next(codes)
                            inner = _short(ids[len(head) : len(ids) - len(tail)]) if _agreed(ids, head, tail) else None
                            out.append(("part", base | n, i, name, pos, None, None, inner, None, None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROW)], schema=_ROW)

    made = durable(known_rows.mapInArrow(encode, _ROW_DDL), "bpe-parts")
    known = made.where("kind = 'core'").groupBy("fp").agg(F.first("ids").alias("_ids"), F.max("salt").alias("_salts")).select("fp", "_ids", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt"))
    parts = made.where("kind = 'part'").select("key", "doc_id", "text_md5", "pos", "fp", "salt", "ids", "head", "tail")
    met = parts.where("fp is not null").drop("ids").join(known, ["fp", "salt"]).withColumnRenamed("_ids", "ids").drop("fp", "salt")
    whole = parts.where("fp is null").drop("fp", "salt").unionByName(met).groupBy("key", "doc_id", "text_md5").agg(F.array_sort(F.collect_list(F.struct("pos", "ids", "head", "tail"))).alias("parts"))
    whole = whole.select("doc_id", "text_md5", F.col("parts.ids").alias("ids"), F.col("parts.head").alias("heads"), F.col("parts.tail").alias("tails"))

    def join(batches):
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for ids, heads, tails in zip(*(part.column(c).to_pylist() for c in ("ids", "heads", "tails"))):
                    codes = [None if x is None else _long(x) for x in ids]
                    fits = all(c is not None and (h is None or _agreed(c, _long(h), _long(t))) for c, h, t in zip(codes, heads, tails))
                    all_ids = np.concatenate(codes) if fits else None
                    out.append((_short(all_ids) if fits and with_ids else None, *(_digests(all_ids, enc.named(all_ids)) if fits else (None, None, None))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_md5"), *[pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string(), pa.string()))]],
                                                 ["doc_id", "text_md5", *_OUT[1:]])

    joined = durable(whole.mapInArrow(join, "doc_id long, text_md5 binary, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"), "bpe-joined")
    out = made.where("kind = 'done'").select(_OUT).unionByName(joined.where("n_tokens is not null").select(_OUT))
    odd = joined.where("n_tokens is null").select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).distinct()
    if not odd.isEmpty():
        again = rows.join(if_small(odd)[0], F.col("doc_id").eqNullSafe(F.col("_id")) & (F.unhex(F.md5("_b")) == F.col("_md5")), "left_semi")
        out = out.unionByName(again.mapInArrow(_whole(path, with_ids), "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string").select(_OUT))
    return _finish(out, with_ids)


def _whole(path: str, with_ids: bool):
    """A function for mapInArrow that encodes each text as it is."""
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for part in _slices(batch, "_b"):
                out = [(_short(ids) if with_ids else None, *_digests(ids, enc.named(ids))) for ids in enc.encode([raw.decode() for raw in part.column("_b").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string(), pa.string()))]], _OUT)

    return run


def _finish(out: DataFrame, with_ids: bool) -> DataFrame:
    if not with_ids:
        return out.drop("ids")

    def unpack(batches):
        for batch in batches:
            for part in _slices(batch, "ids", 1024):
                ids = pa.array([_long(x).astype(np.int32) for x in part.column("ids").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_tokens"), part.column("ids_sha256"), part.column("decoded_sha256"), ids], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return out.mapInArrow(unpack, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and the decoded text of rows with doc_id and ids array<int>; null ids decode to an empty text."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([enc.library.decode(x or [], skip_special_tokens=False) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def brute_force(texts: list[str | None], path: str | None = None) -> list[tuple[int, str, str]]:
    """n_tokens and both digests of each text straight from the library: for tests."""
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path or default_tokenizer())
    library.no_padding()
    library.no_truncation()
    out = []
    for x in texts:
        ids = library.encode(x or "", add_special_tokens=False).ids
        out.append(_digests(np.array(ids, "<u4"), library.decode(ids, skip_special_tokens=False).encode()))
    return out
