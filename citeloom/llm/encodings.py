"""Text that was decoded with the wrong encoding: found and, where possible, restored by noisy-channel decoding.

The channel is a pair (codec a text was read with, codec it was written in), once or twice over.  Undoing it turns a token
into a lattice of bytes, in which a lost byte is a wildcard, and decodes it as the codec it was written in.  A character with
a lost byte is first left open; what fills it is the most frequent word of the corpus that has the same letters around it, and
only where there is none the most frequent character that fits the bytes that are known.  The readings of every different token
are then held against the token itself under the word counts of the whole corpus, and a Viterbi search over the tokens of a
field, with the channels and "undamaged" as states, picks the damaged spans.

Damage often covers whole files.  Word counts are therefore also taken file by file: a reading that is usual outside a file
beside a token that is not speaks for its channel there, whatever share of all rows the file holds.  In a file with enough such
tokens, fewer if ``encoding_used`` names the codec the channel reads with, weaker evidence does.

Word, character and letter-pair counts cover all texts.  Word counts are joined, not broadcast; only the characters, which cannot
exceed the number of Unicode code points, and the pairs of letters below U+0600 go to every worker.

Cases: a field with U+FFFD or a C1 control is damaged even if nothing can be restored; null and blank fields are no case;
text in pure ASCII is never a case; white space is kept as it is; texts of any length are read whole; rows with the same id are
cases of their own but give one row; records without a file, and tables without that column, are judged by their fields alone;
extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import settle

FIELDS = ("title", "abstract")
LOST = "�"
#: (codec the text was read with, codec it was written in, how often)
CHANNELS: tuple[tuple[str, str, int], ...] = (
    ("cp1252", "utf-8", 1), ("latin-1", "utf-8", 1), ("cp1252", "utf-8", 2), ("latin-1", "utf-8", 2),
    ("cp850", "utf-8", 1), ("cp437", "utf-8", 1), ("mac_roman", "utf-8", 1), ("gbk", "utf-8", 1), ("cp1250", "utf-8", 1), ("cp1251", "utf-8", 1),
    ("cp1252", "cp1251", 1), ("latin-1", "cp1251", 1), ("mac_roman", "cp1251", 1), ("cp850", "cp1251", 1), ("cp1252", "koi8_r", 1),
    ("cp1252", "gbk", 1), ("latin-1", "gbk", 1), ("mac_roman", "gbk", 1), ("cp850", "gbk", 1),
    ("mac_roman", "cp1252", 1), ("cp850", "cp1252", 1), ("gbk", "cp1252", 1), ("cp1250", "cp1252", 1), ("cp1251", "cp1252", 1),
    ("cp1252", "mac_roman", 1), ("latin-1", "mac_roman", 1), ("cp1252", "cp850", 1), ("latin-1", "cp850", 1), ("latin-1", "cp1252", 1), ("gbk", "mac_roman", 1),
    ("cp1252", "cp1250", 1), ("latin-1", "cp1250", 1), ("cp1251", "koi8_r", 1), ("koi8_r", "cp1251", 1), ("cp866", "cp1251", 1), ("cp1251", "cp866", 1),
    ("mac_roman", "koi8_r", 1), ("latin-1", "koi8_r", 1), ("koi8_r", "utf-8", 1), ("cp866", "utf-8", 1), ("big5", "utf-8", 1), ("cp1252", "big5", 1), ("latin-1", "shift_jis", 1),
)
#: A word of the corpus counts against a token if it is met so often, and so many times as often as the token.
LEAST_WORDS, LEAST_RATIO = 5, 10
#: The gain in log probability by characters alone that makes a token of several foreign letters damaged.
LEAST_GAIN = 8.0
SWITCH = 2.0
#: Strength of a reading that is a word of the corpus and no more, and what an active channel of the file adds.
WEAK, IN_FILE = 0.5, 2.0
#: A channel is active in a file with so many different words for it and this share of the file's tokens, or a smaller one if
#: the file's encoding agrees.
FILE_WORDS, FILE_SHARE, AGREED_SHARE = 3, 0.3, 0.1
_DOUBLE = ("gbk", "big5", "shift_jis")
_CYRILLIC = ("cp1251", "koi8_r", "cp866")
_ENCODE: dict[str, dict[str, bytes]] = {}


def _encoder(codec: str) -> dict[str, bytes]:
    """The bytes of each character of a single-byte codec; bytes it leaves undefined are read as C1 controls."""
    if codec not in _ENCODE:
        m = {chr(b): bytes([b]) for b in range(128, 160)} if codec in ("cp1252", "latin-1", "cp1250", "cp1251", "koi8_r", "cp866") else {}
        for b in range(256):
            try:
                m[bytes([b]).decode(codec)] = bytes([b])
            except UnicodeDecodeError:
                pass
        _ENCODE[codec] = m
    return _ENCODE[codec]


def to_bytes(text: str, codec: str) -> list[int] | None:
    """The bytes that were read as ``text``, -1 for a lost one; None if ``codec`` can't have given this text."""
    out: list[int] = []
    if codec in ("gbk", "big5"):
        for part in re.split(f"({LOST})", text):
            if part == LOST:
                out.append(-1)
            else:
                try:
                    out.extend(part.replace("€", "\x80").encode("latin-1") if part == "€" else part.encode(codec))
                except UnicodeEncodeError:
                    return None
        return out
    table = _encoder(codec)
    for ch in text:
        if ch == LOST:
            out.append(-1)
        else:
            b = table.get(ch)
            if b is None:
                return None
            out.append(b[0])
    return out


class Speech:
    """Character and letter-pair statistics of the corpus."""

    def __init__(self, counts: dict[str, int]):
        self.counts = {c: n for c, n in counts.items() if len(c) == 1}
        self.total = max(1, sum(self.counts.values()))
        self.pairs = {c: n for c, n in counts.items() if len(c) == 2}
        self.firsts: dict[str, int] = {}
        for c, n in self.pairs.items():
            self.firsts[c[0]] = self.firsts.get(c[0], 0) + n
        self._fitting: dict[str, dict[tuple[int, tuple[int, ...]], str]] = {}

    def fitting(self, codec: str) -> dict[tuple[int, tuple[int, ...]], str]:
        """(bytes of the whole sequence, known bytes with -1 for lost ones, fewer where it is cut off) -> most frequent character."""
        if codec not in self._fitting:
            found = self._fitting[codec] = {}
            for ch in sorted(self.counts, key=lambda c: -self.counts[c]):
                if 128 <= ord(ch) < 0x10000 and not 0xD800 <= ord(ch) < 0xE000 and self.counts[ch] > 1 and ch != LOST:
                    try:
                        b = ch.encode(codec)
                    except UnicodeEncodeError:
                        continue
                    for size in range(1, len(b) + 1):
                        for known in itertools.product(*((x, -1) for x in b[:size])):
                            found.setdefault((len(b), known), ch)
        return self._fitting[codec]

    def log(self, ch: str) -> float:
        if ch < "\x80":
            return -4.1
        if ch == LOST or "\x80" <= ch < "\xa0":
            return -16.0
        n = self.counts.get(ch, 0)
        return math.log(n / self.total) if n > 1 else -16.0

    def text(self, s: str) -> float:
        return sum(map(self.log, s))

    def flow(self, s: str) -> float:
        """Log probability of the sequence of letters beyond ASCII, letter case aside."""
        s = s.lower()
        return sum(math.log((self.pairs.get(a + b, 0) + 0.1) / (self.firsts.get(a, 0) + 4.0)) for a, b in zip(s, s[1:]) if a >= "\x80" and b >= "\x80")


def decoded(data: list[int], codec: str, speech: Speech, open_: bool = False) -> str | None:
    """The most probable reading of a lattice of bytes with wildcards; a sequence may be cut off at the end.

    With ``open_`` the characters that have a wildcard are given as U+FFFD.
    """
    if codec not in ("utf-8", *_DOUBLE):
        table = _decoder(codec)
        out = [LOST if b == -1 else table.get(b) for b in data]
        return None if None in out else "".join(out)  # type: ignore[arg-type]
    n = len(data)
    fitting = speech.fitting(codec) if -1 in data or codec == "utf-8" else {}
    best: list[tuple[float, int, str] | None] = [None] * (n + 1)  # (score, where the last character begins, that character)
    best[0] = 0.0, 0, ""
    for i in range(n):
        if best[i] is None:
            continue
        score = best[i][0]  # type: ignore[index]
        b = data[i]
        options: list[tuple[int, str]] = []
        if 0 <= b < 128:
            options.append((1, chr(b)))
        else:
            if codec == "utf-8":
                sizes = (2,) if 0xC2 <= b < 0xE0 else (3,) if 0xE0 <= b < 0xF0 else (4,) if 0xF0 <= b < 0xF5 else (2, 3) if b == -1 else ()
            else:
                sizes = (2,)
            for size in sizes:
                seq = data[i : i + size]
                if -1 not in seq and len(seq) == size:
                    try:
                        options.append((size, bytes(seq).decode(codec)))
                    except UnicodeDecodeError:
                        pass
                elif (fit := fitting.get((size, tuple(seq)))) is not None:
                    options.append((len(seq), fit))
        for size, ch in options:
            new = score + speech.log(ch) - (2.0 if -1 in data[i : i + size] else 0.0)
            if best[i + size] is None or new > best[i + size][0]:  # type: ignore[index]
                best[i + size] = new, i, ch
    out, at = [], n
    while at and best[at] is not None:
        end = at
        _, at, ch = best[at]  # type: ignore[misc]
        out.append(LOST if open_ and -1 in data[at:end] else ch)
    return None if at else "".join(reversed(out))


_DECODE: dict[str, dict[int, str]] = {}


def _decoder(codec: str) -> dict[int, str]:
    if codec not in _DECODE:
        m = {}
        for b in range(256):
            try:
                m[b] = bytes([b]).decode(codec)
            except UnicodeDecodeError:
                pass
        _DECODE[codec] = m
    return _DECODE[codec]


def undo(text: str, channel: tuple[str, str, int], speech: Speech, open_: bool = False) -> str | None:
    """What ``text`` was before it went through the channel, None if it can't have."""
    read, written, times = channel
    for k in range(times):
        data = to_bytes(text, read)
        if data is None:
            return None
        got = decoded(data, written, speech, open_ and k == times - 1)
        if got is None or got == text:
            return None
        text = got
    return text


def _foreign(s: str) -> int:
    return sum(c >= "\x80" for c in s)


def candidates(word: str, speech: Speech) -> list[tuple[int, str, str, float, float]]:
    """(channel, reading, reading with open characters, gain by characters, gain by pairs) of each channel that may have given ``word``."""
    out = []
    own, flow = speech.text(word), None
    lost = LOST in word
    for i, ch in enumerate(CHANNELS):
        got = undo(word, ch, speech)
        if got is None or any(speech.log(c) <= -16.0 and not (lost and c == LOST) for c in got):
            continue
        gain = speech.text(got) - own
        if gain > -6.0:
            if flow is None:
                flow = speech.flow(word)
            out.append((i, got, undo(word, ch, speech, True) if lost else got, gain, speech.flow(got) - flow))
    return out


def plain(token: Column) -> Column:
    """A token with its numbers and codes made alike, so that counts tell about its letters."""
    return F.regexp_replace(F.regexp_replace(token, "[0-9]+", "0"), "[A-Z]{2,}(?=-?0)", "X")


def tokens(records: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, file, field, pos, token, word) of all tokens with a character beyond ASCII."""
    file = F.col("source_file_id").cast("long") if "source_file_id" in records.columns else F.lit(None).cast("long")
    e = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    x = records.select(F.col("id").cast("long").alias("id"), file.alias("file"), F.explode(e).alias("e")).select("id", "file", "e.field", "e.text")
    x = x.filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    x = x.select("id", "file", "field", F.posexplode(F.split("text", r"[ \t\r\n]+")).alias("pos", "token")).filter(F.col("token").rlike(r"[^\x00-\x7F]"))
    return x.withColumn("word", plain(F.col("token")))


_PROPOSED = "word string, n long, channel int, reading string, pattern string, gain double, flow double"


def _propose(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speech = Speech(shared.value)
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for way in candidates(word, speech):
                    for c, v in zip(cols, (word, n, *way)):
                        c.append(v)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in _PROPOSED.split(", ")])

    return run


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the characters beyond ASCII of words (word, n), and of pairs of letters below U+0600."""
    total: Counter[str] = Counter()
    for b in batches:
        for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for c in {c for c in word if c >= "\x80"}:
                total[c] += n
            low = word.lower()
            for x, y in zip(low, low[1:]):
                if "\x80" <= x < "\u0600" and "\x80" <= y < "\u0600":
                    total[x + y] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["c", "n"])


def statistics(words: DataFrame):
    """The counts of ``Speech`` for every worker."""
    told = words.select("word", "n").mapInArrow(_letters, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))
    return words.sparkSession.sparkContext.broadcast({r["c"]: r["n"] for r in told.toLocalIterator()})


def mask(word: Column) -> Column:
    return F.regexp_replace(word, r"[^\x00-\x7F]", LOST)


def _agree(pattern: Column, word: Column) -> Column:
    """Whether ``word`` has the characters of ``pattern`` at all places that are not open."""
    return F.forall(F.zip_with(F.split(pattern, ""), F.split(word, ""), lambda a, b: (a == b) | (a == LOST)), lambda x: x)


def _of_channel(i: int) -> Column:
    return F.element_at(F.array(*[F.lit(c[i]) for c in CHANNELS]), F.col("channel") + 1)


def verdicts(words: DataFrame, shared) -> tuple[DataFrame, DataFrame]:
    """((word, ways): for each word the channels that may explain it, with their strength and reading; the single readings with
    counts) from words (word, n)."""
    spark = words.sparkSession
    made = words.repartition(spark.sparkContext.defaultParallelism, "word").mapInArrow(_propose(shared), _PROPOSED)
    whole = words.filter(~F.col("word").contains(LOST) & (F.col("n") > 1) & ~F.col("word").rlike(r"[\x{80}-\x{9f}]")).withColumn("mask", mask(F.col("word")))
    # a reading is compared as it would be counted
    made = settle(made.withColumns({"as_word": plain(F.col("reading")), "pattern": plain(F.col("pattern"))}), "made")
    # readings with open characters: the most frequent word of the corpus that has the others
    open_ = made.filter(F.col("pattern").contains(LOST)).select("word", "channel", "pattern", mask(F.col("pattern")).alias("mask"))
    full = open_.join(whole.select("mask", F.col("word").alias("w"), "n"), "mask").filter(_agree(F.col("pattern"), F.col("w"))).groupBy("word", "channel").agg(F.max_by("w", "n").alias("full"))
    made = made.join(full, ["word", "channel"], "left").withColumn("as_word", F.coalesce("full", "as_word"))
    known = made.join(words.select(F.col("word").alias("as_word"), F.col("n").alias("m")), "as_word", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    read, written = _of_channel(0), _of_channel(1)
    beyond = F.length(F.regexp_replace("word", r"[\x00-\x7F]", ""))
    by_word = (F.col("m") >= LEAST_WORDS) & (F.col("m") >= LEAST_RATIO * F.col("n"))
    shorter = (F.length("reading") < F.length("word")) | ((read == "gbk") & (F.length("reading") == F.length("word")))
    # where many characters are lost and no byte beyond ASCII is left to tell, only a word of the corpus will do
    told = (F.length(F.regexp_replace("word", f"[^{LOST}]", "")) <= 4) | F.col("word").rlike(f"[^\\x00-\\x7F{LOST}]") | (F.col("m") > 0)
    by_form = told & (written == "utf-8") & shorter & (F.col("gain") > 0) & (F.col("n") < 20 * (F.col("m") + 50))
    # between two Cyrillic codecs letter case flips and tells nothing; the sequence of the letters does
    swapped = read.isin(*_CYRILLIC) & written.isin(*_CYRILLIC)
    fluent = F.when(swapped, (F.col("flow") > LEAST_GAIN) & (F.col("flow") > 1.0 * beyond)).otherwise((F.col("gain") > LEAST_GAIN) & (F.col("gain") > 2.0 * F.length("reading")))
    by_chars = told & written.isin("gbk", *_CYRILLIC) & (beyond >= 4) & fluent
    # a single Cyrillic letter or a mark on its own is too little
    alone = (F.length("word") == 1) & F.col("word").rlike(r"[\x{400}-\x{52f}]|[^\p{L}]") & (written != "utf-8")
    strength = F.when(by_word, 4.0 + F.log((F.col("m") + 1.0) / (F.col("n") + 1.0))).otherwise(F.lit(0.0)) + F.when(by_form, 6.0 + 0.1 * F.col("gain")).otherwise(0.0) + F.when(by_chars, 6.0 + 0.1 * F.greatest("gain", F.lit(0.0))).otherwise(0.0)
    strength = F.when(alone, F.least(strength, F.lit(SWITCH - 0.1))).otherwise(strength)
    weak = (F.col("m") >= LEAST_WORDS) & (F.length("word") > 1) & F.when(swapped, F.col("flow") > 0).otherwise(F.col("gain") > 0)
    known = settle(known.withColumn("strength", F.greatest(strength, F.when(weak, WEAK).otherwise(0.0))).filter("strength > 0").select("word", "n", "channel", "as_word", "m", "strength", "reading", "full"), "known")
    ways = known.groupBy("word").agg(F.collect_list(F.struct("channel", "strength", F.coalesce("full", "reading").alias("reading"))).alias("ways"))
    # lost characters that no channel explains: the most frequent word with the same letters around the gaps
    wanted = words.filter(F.col("word").contains(LOST)).select("word", mask(F.col("word")).alias("mask"))
    filled = whole.join(wanted.select("mask").distinct(), "mask", "left_semi").groupBy("mask").agg(F.max_by("word", "n").alias("reading"))
    lost = wanted.join(filled, "mask", "left").select("word", F.array(F.struct(F.lit(-1).alias("channel"), F.lit(8.0).cast("double").alias("strength"), "reading")).alias("ways"))
    both = ways.unionByName(lost).groupBy("word").agg(F.flatten(F.collect_list("ways")).alias("ways"))
    strong = both.filter(F.exists("ways", lambda w: w["strength"] > SWITCH))
    control = words.filter(F.col("word").rlike(r"[\x{80}-\x{9f}]")).join(strong.select("word"), "word", "left_anti")
    lone = control.select("word", F.array(F.struct(F.lit(-1).alias("channel"), F.lit(8.0).cast("double").alias("strength"), F.lit(None).cast("string").alias("reading"))).alias("ways"))
    return both.join(lone.select("word"), "word", "left_anti").unionByName(lone), known


def _codec(c: Column) -> Column:
    """The name of an encoding as the channels write it."""
    x = F.regexp_replace(F.lower(F.trim(c)), "[ _-]", "")
    table = {"utf8": "utf-8", "utf8sig": "utf-8", "latin1": "latin-1", "iso88591": "latin-1", "windows1252": "cp1252", "windows1251": "cp1251", "windows1250": "cp1250", "macroman": "mac_roman", "koi8r": "koi8_r"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x), x)


def active_channels(toks: DataFrame, known: DataFrame, files: DataFrame | None) -> DataFrame:
    """(file, active): the channels that whole files went through, told by words that are unusual outside the file beside readings
    that are usual there."""
    here = toks.filter("file is not null").groupBy("file", "word").agg(F.count("*").alias("here"))
    here = settle(here, "by_file")
    x = known.select("word", "n", "channel", "as_word", "m", "strength").join(here, "word")
    x = x.join(here.select("file", F.col("word").alias("as_word"), F.col("here").alias("m_here")), ["file", "as_word"], "left")
    out_n, out_m = F.col("n") - F.col("here"), F.col("m") - F.coalesce("m_here", F.lit(0))
    x = x.filter((F.col("strength") > SWITCH) | ((out_m >= LEAST_WORDS) & (out_m >= LEAST_RATIO * out_n) & (F.length("word") > 2)))
    g = x.groupBy("file", "channel").agg(F.count("*").alias("words"), F.sum("here").alias("hits"))
    g = g.join(here.groupBy("file").agg(F.sum("here").alias("all")), "file")
    share = F.lit(FILE_SHARE)
    if files is not None:
        told = files.groupBy(F.col("id").cast("long").alias("file")).agg(F.min(_codec(F.col("encoding_used"))).alias("used"))
        g = g.join(told, "file", "left")
        share = F.when(F.col("used") == _of_channel(0), AGREED_SHARE).otherwise(FILE_SHARE)
    return g.filter((F.col("words") >= FILE_WORDS) & (F.col("hits") >= share * F.col("all"))).groupBy("file").agg(F.collect_set("channel").alias("active"))


def viterbi(spans: list[tuple[int, list[tuple[int, float]]]]) -> list[tuple[int, int]]:
    """(position, channel) of the damaged tokens on the best path; states are the channels and None for undamaged."""
    paths: dict[int | None, tuple[float, list[tuple[int, int]]]] = {None: (0.0, [])}
    for pos, ways in spans:
        top = max(paths.values(), key=lambda p: p[0])
        new = {s: p for s, p in paths.items()}  # passing the token by as undamaged costs nothing and keeps the state
        for ch, strength in ways:
            if strength <= 0:
                continue
            stay = paths.get(ch)
            jump = top[0] - SWITCH, top[1]
            base = stay if stay is not None and stay[0] >= jump[0] else jump
            got = base[0] + strength, [*base[1], (pos, ch)]
            if ch not in new or got[0] > new[ch][0]:
                new[ch] = got
        paths = new
    return max(paths.values(), key=lambda p: p[0])[1]


def _decide(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speech = Speech(shared.value)
        for b in batches:
            ids, fields, at, old, fixed = [], [], [], [], []
            for i, field, parts, active in zip(*(b.column(k).to_pylist() for k in range(4))):
                more = {c: IN_FILE for c in active or ()}
                parts.sort(key=lambda p: p["pos"])
                by_pos = {p["pos"]: p for p in parts}
                # weak readings follow a channel, they don't speak for one
                told = {w["channel"] for p in parts for w in p["ways"] if w["strength"] > SWITCH} | set(more)
                path = viterbi([(p["pos"], [(w["channel"], w["strength"] + more.get(w["channel"], 0.0)) for w in p["ways"] if w["strength"] > WEAK or w["channel"] in told]) for p in parts])
                for pos, ch in path:
                    p = by_pos[pos]
                    way = next(w for w in p["ways"] if w["channel"] == ch)
                    new = undo(p["token"], CHANNELS[ch], speech) if ch >= 0 else p["token"]
                    if LOST in p["token"]:
                        # a word of the corpus goes before the characters that fit
                        gaps = undo(p["token"], CHANNELS[ch], speech, True) if ch >= 0 else p["token"]
                        new = fill(gaps, way["reading"]) or (new if new and LOST not in new else None)
                    elif ch < 0:
                        new = None
                    ids.append(i), fields.append(field), at.append(pos), old.append(p["token"]), fixed.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fields, pa.string()), pa.array(at, pa.int32()), pa.array(old, pa.string()), pa.array(fixed, pa.string())], names=["id", "field", "pos", "token", "fixed"])

    return run


def fill(token: str | None, reading: str | None) -> str | None:
    """A token with the lost characters that ``reading``, a word with numbers and codes made alike, has at the gaps."""
    if reading is None or not token or token.count(LOST) == 0 or LOST in reading:
        return None
    given = [c for c in reading if c >= "\x80"]
    if len(given) != sum(c >= "\x80" for c in token):
        return None
    put = iter(given)
    return "".join(next(put) if c >= "\x80" else c for c in token)


def repairs(records: DataFrame, files: DataFrame | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, pos, token, fixed): every damaged token, with its restored form or null where that can't be told."""
    toks = tokens(records, fields)
    words = settle(toks.groupBy("word").agg(F.count("*").alias("n")), "words")
    shared = statistics(words)
    told, known = verdicts(words, shared)
    told = settle(told, "verdicts")
    active = active_channels(toks, known, files)
    hit = toks.join(told, "word").groupBy("id", "field", "file").agg(F.collect_list(F.struct("pos", "token", "ways")).alias("parts")).join(active, "file", "left")
    return settle(hit.select("id", "field", "parts", "active").mapInArrow(_decide(shared), "id long, field string, pos int, token string, fixed string"), "repairs")


def damaged(records: DataFrame, files: DataFrame | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(record_id, field_name) of the fields whose text was decoded with the wrong encoding."""
    return repairs(records, files, fields).select(F.col("id").alias("record_id"), F.col("field").alias("field_name")).distinct()


def restored(records: DataFrame, files: DataFrame | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(record_id, field_name, text, complete): the damaged fields with all tokens restored that can be and white space as it was."""
    fix = repairs(records, files, fields).groupBy("id", "field").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("pos", F.coalesce("fixed", "token").alias("f"))))).alias("m"), F.min(F.col("fixed").isNotNull()).alias("complete")
    )
    e = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    x = records.dropDuplicates(["id"]).select(F.col("id").cast("long").alias("id"), F.explode(e).alias("e")).select("id", "e.field", "e.text").join(fix, ["id", "field"])
    put = F.transform(F.split("text", r"[ \t\r\n]+"), lambda t, i: F.coalesce(F.element_at("m", i), t))
    pieces = F.zip_with(put, F.regexp_extract_all("text", F.lit(r"([ \t\r\n]+)")), lambda t, gap: F.concat(t, F.coalesce(gap, F.lit(""))))
    return x.select(F.col("id").alias("record_id"), F.col("field").alias("field_name"), F.array_join(pieces, "").alias("text"), "complete")
