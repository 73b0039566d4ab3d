"""Variant spellings of typed names, tied to the entries of an authority file.

The surnames, places and whole titles of the authority are indexed by symmetric deletes: a token and all its forms with one
letter left out, two for surnames of ``LONG`` letters or more.  A mention looks up its own tokens the same way, so tokens so
many edits apart (a swap of neighbours counts as one) meet without comparing all pairs.  What is left of the mention is
assigned to what is left of the entry at the least cost: given names may be shortened to initials, cut, exchanged for a usual
short form, misspelt by one edit or reordered; words of a title, however many, may be cut and reordered.  An assignment that
leaves a word of the entry's title, the first given name or an unexplained word of the mention over is no match.

The less of a surname is left to go by, the more the given name has to tell: a misspelt surname below ``SURE`` letters and one
two edits off count only with the given name in full.  A surname or title that is off is taken for a misspelling only if it is
rare beside the entry's own spelling in the whole corpus (at most ``MOST_SHARE``, as far as the counts can tell); otherwise it's
the name of somebody else.

The authority goes to every worker, ``MOST_ENTRIES`` at a time; a larger one is read in as many passes as it needs.

Cases: null, blank and broken author lists name nobody; null names are passed over; a surname alone names nobody; words like
``Dr`` are left out unless they are the name (``Ma, Jun``); ties between entries of one kind give the entry with the fewest
edits, and none if these are equal; repeated rows count once; names of any length are read whole; empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import lookalikes
from citeloom.llm.lookalikes import consistent, names_of
from citeloom.session import settle

MOST_ENTRIES = 50_000
#: A misspelling occurs at most this often for each occurrence of the right spelling.
MOST_SHARE = 0.12
CACHE = 200_000
#: Surnames of so many letters are indexed with two deletes; shorter ones than ``SURE`` need the given name in full to be misspelt.
LONG, SURE = 9, 5

# Common English given names and their usual short forms that no rule of ``short_form`` gives.
SHORT = {
    "abigail": "gail abby", "abraham": "bram", "agnes": "nessie", "albert": "bert bertie", "alexander": "xander sandy sasha sascha alec lex", "alexandra": "sandra sandy sasha", "alfred": "fred freddie",
    "amelia": "milly mia", "andrew": "drew", "anna": "nancy annie", "anthony": "tony", "arthur": "art", "barbara": "babs barbie", "beatrice": "trixie", "bernard": "bernie", "bridget": "biddy bridie",
    "caroline": "carrie lina", "catherine": "kate kathy kitty katie kay cathy", "charles": "chuck chas chaz", "charlotte": "lottie lotte", "christina": "tina kirsty", "christopher": "kit topher",
    "clarence": "clare", "cornelius": "neil con", "cynthia": "cindy", "daniel": "danny", "deborah": "debbie debs", "dorothy": "dolly dot dottie dora", "edith": "edie", "edmund": "ned ted",
    "edward": "ned ted teddy ward", "eleanor": "nell nora ellie ella", "elizabeth": "beth betsy betty liz lizzie libby lisa bess bessie eliza elsie", "emily": "milly emmy", "ernest": "ernie", "eugene": "gene",
    "evelyn": "evie", "florence": "flo flossie", "frances": "fanny fran frankie", "francis": "frank", "frederick": "fritz rick", "gabriella": "ella", "george": "geordie", "geoffrey": "jeff", "gerald": "gerry jerry",
    "gertrude": "trudy", "gilbert": "bert", "gregory": "greg", "harold": "hal harry", "harriet": "hattie", "helen": "nell nellie", "helena": "lena nell", "henrietta": "etta hattie hetty", "henry": "hal harry hank",
    "herbert": "bert", "hubert": "bert", "ignatius": "iggy", "isabella": "bella izzy", "isidore": "izzy", "jacob": "jake", "jacqueline": "jackie", "james": "jim jimmy jamie", "jane": "jenny",
    "janet": "jess", "jeremiah": "jerry", "jerome": "jerry", "joan": "joanie", "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey", "josephine": "jo josie", "judith": "judy", "katarzyna": "kasia", "katherine": "kate kathy kitty katie kay",
    "laura": "lolly", "lawrence": "larry laurie", "leonard": "lenny leo", "leopold": "leo", "lillian": "lily", "lucille": "lucy", "magdalena": "lena", "margaret": "peggy meg maggie madge daisy greta rita", "maria": "mary mia",
    "martha": "patty", "martin": "marty", "mary": "molly polly mamie may", "matilda": "tilly", "matthew": "matt", "maximilian": "max", "melissa": "lissa missy", "michael": "mike mick mickey micky", "mildred": "milly", "montgomery": "monty",
    "nathaniel": "nate nat", "nicholas": "nick nico klaus colin", "oliver": "ollie noll", "pamela": "pam", "patricia": "trish tricia patty paddy", "patrick": "paddy", "penelope": "penny", "peter": "pete", "philip": "pip",
    "priscilla": "cilla", "raymond": "ray", "rebecca": "becky becca", "reginald": "reg", "richard": "dick rick ricky", "robert": "bob bobby rob robbie bert", "roderick": "rod rick", "roland": "rollo", "ronald": "ron", "rosalind": "roz",
    "rudolph": "rolf rudi", "samantha": "sam", "sarah": "sally sadie", "sebastian": "bastian", "sigmund": "ziggy", "silvester": "sly", "stephen": "steve", "susan": "sue sukie", "susanna": "sue susie", "thaddeus": "tad", "theodore": "ted teddy",
    "theresa": "tess terry tracy", "thomas": "tom tommy", "ursula": "ulla", "valentine": "val", "veronica": "ronnie", "victor": "vic", "victoria": "vicky tori", "virginia": "ginny", "walter": "wally walt", "wilhelmina": "minnie mina", "william": "bill billy liam", "winifred": "freda winnie", "zachary": "zack zach",
}
_SHORT = {k: set(v.split()) for k, v in SHORT.items()}
_HONOURS = {"prof", "professor", "dr", "mr", "mrs", "ms", "miss", "sir", "phd", "md", "msc", "ba", "ma", "mph", "jr", "sr", "rn", "frcp"}
_FILLERS = {"of", "the", "and", "for", "in", "on", "online", "print", "official", "organ", "electronic", "internet", "ed", "a"}
# Words for the kind of a journal; the other words of a title tell which one it is.
_KINDS = set("journal annals archives archive bulletin proceedings transactions yearbook review reviews acta letters international american european british".split())
_SPECIAL = {"ø": "o", "ł": "l", "ß": "ss", "ı": "i", "đ": "d", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d"}
_SPECIALS = re.compile(f"[{''.join(_SPECIAL)}]")
_MARKS = regex.compile(r"\p{Mn}+")
_DIGRAPHS = str.maketrans({"ö": "oe", "ü": "ue", "ä": "ae", "å": "aa", "ø": "oe"})


def folded(text: str) -> str:
    """Lower case without marks."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFD", _SPECIALS.sub(lambda m: _SPECIAL[m.group()], text.lower())))


def letters(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


def without_honours(words: list[str]) -> list[str]:
    return [w for w in words if w and folded(w.strip(",")) not in _HONOURS]


def short_form(full: str, typed: str) -> bool:
    """Whether ``typed`` is a usual short form of a given name: a listed one, or its beginning with ``y`` or ``ie`` at the end."""
    if typed in _SHORT.get(full, ()):
        return True
    for end in ("y", "ie", "i", "ey"):
        stem = typed[: -len(end)]
        if typed.endswith(end) and len(stem) >= 3 and stem[0] == full[0] and (full.startswith(stem) or stem[-1] == stem[-2] and full.startswith(stem[:-1]) or stem.endswith("ck") and full.startswith(stem[:-1])):
            return True
    return False


def deletes(word: str, most: int = 1) -> set[str]:
    """``word`` and its forms with up to ``most`` letters left out."""
    out = {word}
    last = out
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def edits(a: str, b: str) -> int:
    """0, 1 or 2 for more: edits between two words, a swap of neighbours being one."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        if a[i + 1 :] == b[i + 1 :]:
            return 1
        return 1 if a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :] else 2
    if len(a) < len(b):
        a, b = b, a
    return 1 if a[i + 1 :] == b[i:] else 2


def distance(a: str, b: str, most: int) -> int:
    """Edits between two strings, swaps being one; ``most`` + 1 for more."""
    if a == b:
        return 0
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    k = 0
    while k < min(len(a), len(b)) and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = (a[:-k], b[:-k]) if k else (a, b)
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    if len(a) > 60 + most and len(b) > 60 + most and most <= 3:
        return most + 1 if len(set(a) ^ set(b)) > 2 * most else _banded(a, b, most)
    return _banded(a, b, most)


def _banded(a: str, b: str, most: int) -> int:
    far = most + 1
    last2: list[int] = []
    last = [j if j <= most else far for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [far] * (len(b) + 1)
        if i <= most:
            row[0] = i
        low = far
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, last2[j - 2] + 1)
            row[j] = v
            low = min(low, v)
        if low > most:
            return far
        last2, last = last, row
    return min(far, last[-1])


def assigned(cost: list[list[int]], far: int) -> int:
    """The least total of an assignment of every row to a column of its own, ``far`` or more if there is none.

    Rows are added one by one along shortest augmenting paths with potentials, so any number of rows is assigned exactly.
    """
    n, m = len(cost), len(cost[0]) if cost else 0
    if n > m or any(min(row) >= far for row in cost):
        return 0 if not n else far
    u, v, owner = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    big = far * (n + 1)
    for i in range(1, n + 1):
        owner[0] = i
        j0, least, came, used = 0, [4 * big] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], 4 * big, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = (cost[i0 - 1][j - 1] if cost[i0 - 1][j - 1] < far else big) - u[i0] - v[j]
                    if c < least[j]:
                        least[j], came[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[came[j0]]
            j0 = came[j0]
    return min(far, sum(min(cost[owner[j] - 1][j - 1], big) for j in range(1, m + 1) if owner[j]))


class Index:
    """Symmetric-delete index: key forms -> entries.  Words of ``long`` letters or more are met over two edits, others over one."""

    def __init__(self, long: int = 1 << 30) -> None:
        self.by: dict[str, set[tuple[str, int]]] = {}
        self.long = long

    def add(self, word: str, entry: int) -> None:
        for d in deletes(word, 2 if len(word) >= self.long else 1):
            self.by.setdefault(d, set()).add((word, entry))

    def near(self, word: str) -> dict[tuple[str, int], int]:
        """(indexed word, entry) -> edits."""
        out: dict[tuple[str, int], int] = {}
        two = len(word) >= self.long - 2
        for d in deletes(word, 2 if two else 1):
            for hit in self.by.get(d, ()):
                if hit not in out:
                    most = 2 if len(hit[0]) >= self.long else 1
                    n = distance(word, hit[0], 2) if most == 2 else edits(word, hit[0])
                    if n <= most:
                        out[hit] = n
        return out


FAR = 9


class Persons:
    def __init__(self, entries: list[tuple[int, str]]):
        self.full = {i: name for i, name in entries}
        self.index, self.parts = Index(LONG), {}
        for i, name in entries:
            surname, _, given = name.partition(",")
            self.parts[i] = [w for w in map(letters, re.split(r"[\s.]+", folded(given))) if w]
            for form in {folded(surname), folded(surname.lower().translate(_DIGRAPHS))}:
                self.index.add(letters(form), i)

    @staticmethod
    def readings(name: str) -> list[tuple[str, list[str]]]:
        """(surname letters, given words as typed) of every way to read ``name``, with and without words that look like titles."""
        name = re.sub(r"\([^)]*\)", " ", name)
        head, comma, tail = name.partition(",")
        split = lambda s: [w for w in re.split(r"[\s.,]+", s) if w]
        if comma:
            h, t = split(head), split(tail)
            t = without_honours(t) or ([] if len(h) > 1 else t)
            if t:
                heads = [without_honours(h)] if without_honours(h) else [h[k:] for k in range(len(h))]
                return [(letters(folded("".join(x))), t) for x in heads]
        words = split(head)
        out = []
        for ws in ([w for w in words], without_honours(words)):
            for i in range(1, len(ws)):
                for r in ((letters(folded("".join(ws[:i]))), ws[i:]), (letters(folded("".join(ws[i:]))), ws[:i])):
                    if r not in out:
                        out.append(r)
        return out

    @staticmethod
    def _stands(typed: str, w: str, full: str) -> int:
        """Edits of one given word (as typed, its letters) against one of the entry's; ``FAR`` if it can't stand for it."""
        if len(w) == 1:
            return 0 if w == full[0] else FAR
        if w == full or len(full) > 1 and (short_form(full, w) or full.startswith(w) and not (typed.isupper() and len(w) <= 2)):
            return 0
        return 1 if min(len(w), len(full)) >= 3 and edits(w, full) < 2 else FAR

    def given(self, entry: int, typed: list[str]) -> tuple[int, bool] | None:
        """(edits in the given names, whether the first one is there in full), None if they can't stand for the entry's."""
        want = self.parts[entry]
        pairs = [(t, w) for t in typed if (w := letters(folded(t)))]
        if not pairs or not want:
            return None
        costs = [[self._stands(t, w, x) for x in want] for t, w in pairs]
        if len(pairs) == 1 and costs[0][0] == FAR and len(pairs[0][1]) <= 3 and pairs[0][0].isupper():
            pairs = [(c, c) for c in pairs[0][1]]  # initials run together
            costs = [[self._stands(t, w, x) for x in want] for t, w in pairs]
        if len(pairs) > len(want):
            return None
        full = lambda r: len(pairs[r][1]) >= 3
        straight = sum(row[k] for k, row in enumerate(costs))
        if straight < FAR:
            return straight, full(0)
        # in another order one word at least has to be more than an initial
        best = None
        for r, row in enumerate(costs):
            if row[0] < FAR and full(r):
                rest = [x[1:] for k, x in enumerate(costs) if k != r]
                n = row[0] + 1 + (assigned(rest, FAR) if rest else 0)
                best = n if n < FAR and (best is None or n < best) else best
        return None if best is None else (best, True)

    def match(self, name: str) -> list[tuple[int | None, str, str, int, int]]:
        """(entry or None if only the surname is near, surname, indexed surname, edits in it, all edits)."""
        best: dict[int, tuple[int, int, str, str]] = {}
        near: dict[str, tuple[str, int]] = {}
        for surname, typed in self.readings(consistent(name, True)):
            if not surname:
                continue
            for (word, entry), n in self.index.near(surname).items():
                if n and len(word) < 3:
                    continue
                if surname not in near or n < near[surname][1]:
                    near[surname] = word, n
                g = self.given(entry, typed)
                if g is None or (n and len(word) < SURE or n > 1) and not (g[1] and g[0] == 0):
                    continue
                if entry not in best or n + g[0] < best[entry][0]:
                    best[entry] = (n + g[0], n, surname, word)
        if not best:
            return [(None, s, w, n, FAR) for s, (w, n) in near.items()]
        low = min(b[0] for b in best.values())
        top = [e for e, b in best.items() if b[0] == low]
        total, n, surname, word = best[top[0]]
        return [(top[0] if len(top) == 1 else None, surname, word, n, total)]


class Titles:
    def __init__(self, entries: list[tuple[int, str]]):
        self.full = {i: name for i, name in entries}
        self.whole, self.word, self.cut, self.words = Index(), Index(), {}, {}
        for i, name in entries:
            w = self._words(name)
            self.words[i] = w
            self.whole.add(self._joined(name), i)
            for x in w:
                if len(x) >= 4 and x not in _KINDS:
                    self.word.add(x, i)
                    for n in range(3, len(x)):
                        self.cut.setdefault(x[:n], set()).add(i)

    @staticmethod
    def _words(name: str) -> list[str]:
        return [w for w in re.findall(r"[^\W_]+", folded(name)) if w not in _FILLERS]

    @staticmethod
    def _joined(name: str) -> str:
        t = re.sub(r"\((online|print|internet|electronic)\)|:\s*official organ.*$", " ", folded(name))
        return letters(re.sub(r"^\s*the\s+", "", t))

    def _aligned(self, entry: int, typed: list[str]) -> int | None:
        """Edits of the best assignment of the entry's words to the typed ones, None if there is none."""
        want = self.words[entry]
        if len(typed) != len(want):
            return None
        cost = []
        for x in want:
            row = []
            for w in typed:
                n = 0 if x == w or (x.startswith(w) and len(w) < len(x)) else edits(x, w) if len(x) >= 5 and len(w) >= 4 else 2
                row.append(FAR if n > 1 or (len(w) < 3 and x not in _KINDS) else n)
            cost.append(row)
        best = assigned(cost, FAR)
        return best if best <= 2 else None

    def match(self, name: str) -> list[tuple[int | None, str, str, int, int]]:
        text = consistent(name)
        joined = self._joined(text)
        best: dict[int, tuple[int, str, str]] = {}
        for (word, entry), n in self.whole.near(joined).items():
            best[entry] = (n, joined, word)
        if not best:
            typed = self._words(text)
            for w in typed:
                for e in {e for _, e in self.word.near(w)} | self.cut.get(w, set()) if len(w) >= 3 else ():
                    n = self._aligned(e, typed)
                    if n is not None and (e not in best or n < best[e][0]):
                        best[e] = (n, "".join(sorted(typed)), self._joined(self.full[e]))
        if not best:
            return []
        low = min(b[0] for b in best.values())
        top = [e for e, b in best.items() if b[0] == low]
        if len(top) > 1:
            return [(None, *best[top[0]][1:], low, low)]
        n, own, word = best[top[0]]
        return [(top[0], own, word, n, n)]



_MENTIONS = "record_id long, person boolean, typed string, name_id long, own string, word string, edits int, total int, differs boolean"


def _scan(shared, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookalikes.use(table)
        persons, titles = shared.value
        known: dict[tuple[bool, str], list[tuple[int | None, str, str, int, int]]] = {}

        def look(is_person: bool, name: str) -> list[tuple[int | None, str, str, int, int]]:
            key = is_person, name
            if key not in known:
                if len(known) > CACHE:
                    known.clear()
                known[key] = (persons if is_person else titles).match(name)
            return known[key]

        for b in batches:
            cols: tuple[list, ...] = tuple([] for _ in range(9))
            for i, authors, journal in zip(*(b.column(k).to_pylist() for k in range(3))):
                mentions = [(True, n) for n in names_of(authors) if n.strip()] if authors else []
                if journal and journal.strip():
                    mentions.append((False, journal))
                for is_person, name in mentions:
                    full = (persons if is_person else titles).full
                    for entry, own, word, n, total in look(is_person, name):
                        for c, v in zip(cols, (i, is_person, name, entry, own, word, n, total, entry is not None and full[entry] != name)):
                            c.append(v)
            kinds = (pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in _MENTIONS.split(", ")])

    return run


def mentions(records: DataFrame, authority: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """One row (see ``_MENTIONS``) for every mention near an entry; name_id null: a namesake."""
    spark = records.sparkSession
    rows = authority.select(F.col("name_id").cast("long").alias("name_id"), "entity_kind", "full_name").filter("name_id is not null and full_name is not null").distinct()
    x = records.select(F.col("id").cast("long").alias("id"), "authors_json", "journal")
    passes = max(1, math.ceil(rows.count() / most))
    # entries are dealt out by their number, so every pass has about ``most`` of them
    rows = settle(rows.withColumn("pass", F.pmod(F.xxhash64("name_id"), F.lit(passes))), "authority")
    found = []
    for k in range(passes):
        part = rows.filter(F.col("pass") == k).collect()
        shared = spark.sparkContext.broadcast((Persons([(r.name_id, r.full_name) for r in part if r.entity_kind == "person"]), Titles([(r.name_id, r.full_name) for r in part if r.entity_kind == "journal"])))
        found.append(x.mapInArrow(_scan(shared, lookalikes.twins(spark)), _MENTIONS))
    if passes == 1:
        return found[0]
    # the passes put together: of each mention the reading with the fewest edits, and none if two entries have as few
    every = reduce(DataFrame.unionByName, found)
    key = ["record_id", "person", "typed"]
    ids = F.collect_set("name_id")
    low = every.groupBy(*key, "total").agg(F.min(F.struct("edits", "own", "word")).alias("s"), F.min_by("differs", F.struct("edits", "own")).alias("differs"), ids.alias("ids"), F.max(F.col("name_id").isNull()).alias("tied"))
    low = low.groupBy(*key).agg(F.min_by(F.struct("total", "s", "differs", "ids", "tied"), "total").alias("r")).select(*key, "r.*")
    one = (F.size("ids") == 1) & ~F.col("tied")
    return low.select(*key, F.when(one, F.get("ids", F.lit(0))).alias("name_id"), "s.own", "s.word", "s.edits", "total", (one & F.col("differs")).alias("differs"))


def variants(records: DataFrame, authority: DataFrame, most_share: float = MOST_SHARE, most: int = MOST_ENTRIES) -> DataFrame:
    """(record_id, name_id): records that name an entry in a spelling other than the entry's own."""
    m = settle(mentions(records, authority, most).drop("typed", "total"), "mentions")
    count = m.groupBy("person", "own", "word", "edits").agg(F.count("*").alias("n"))
    right = count.filter("edits = 0").groupBy("person", "word").agg(F.sum("n").alias("right"))
    off = count.filter("edits > 0").join(right, ["person", "word"], "left")
    # a misspelling is rarer than ``most_share`` of the right spellings; few occurrences can't tell, so the bound has their spread
    bound = F.lit(most_share) * F.coalesce("right", F.lit(0))
    slips = off.filter(F.col("n") <= bound + 2 * F.sqrt(bound) + 1).select("person", "own", "word", "edits")
    named = m.filter("name_id is not null and differs")
    kept = named.filter("edits > 0").join(slips, ["person", "own", "word", "edits"], "left_semi")
    return named.filter("edits = 0").unionByName(kept).select("record_id", "name_id").distinct()
