"""Author entries that mean the same person or consortium: merge and rematch.

Equal spellings are one profile from the start. In each round every profile - the union of its
merged spellings, initials, affiliations and ORCIDs - is posted to blocks:

* its ORCID;
* affiliation, possible given-name initial and first, or last, letter of the family name (a slip
  changes at most one of the two letters);
* family name and initial alone, for entries without affiliation; once no link is left, also the
  family name's one-deletion variants, and the only profile that fits over all of them is joined.

Within a block, work is linear: family names meet through their one-deletion variants, and a
profile is compared with those of the same family only. Spelt-out given names must agree (slips
and nicknames allowed); an initial joins a spelt-out name only if that is the only one it fits;
different ORCIDs never meet; equal names at different affiliations stay apart unless an ORCID
joins them. Found links are merged by connected components, and the richer profiles are posted
again, until a round finds no link.

Blocks are keyed so that no group of equal names forms one: equal spellings are collapsed before
any block is made. Nulls: a null or blank name makes no profile; a null affiliation or ORCID is
missing evidence. Repeated rows count once. Empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.session import checkpoint

#: Nicknames, titles, consortium words and institution words with their short forms.
NICKNAMES: dict[str, set[str]] = {}
for _full, _short in {
    "alexander": "alex sasha sascha xander", "alexandra": "alex sasha", "anthony": "tony", "benjamin": "ben benny", "christopher": "chris kit", "christian": "chris",
    "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dolores": "lola", "dorothea": "dorle thea", "edward": "ed eddie ted",
    "elizabeth": "liz beth betty eliza", "francisco": "paco pancho", "friedrich": "fritz fred", "gabriela": "gabi", "gabriele": "gabi", "guadalupe": "lupe",
    "gregory": "greg", "heinrich": "heinz", "ignacio": "nacho", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hans hannes", "john": "jack johnny",
    "jonathan": "jon", "jose": "pepe", "josef": "sepp", "joseph": "joe joey", "katherine": "kate kathy katie kat", "ludwig": "lutz", "margaret": "maggie meg peggy",
    "matthew": "matt", "maximilian": "max", "michael": "mike mick", "nicholas": "nick", "nikolai": "kolya", "patricia": "pat patty trish", "patrick": "pat paddy",
    "philip": "phil", "rebecca": "becky", "richard": "dick rick rich", "robert": "bob rob bobby", "samantha": "sam", "samuel": "sam", "sebastian": "basti",
    "stephen": "steve", "susan": "sue susie", "susanna": "sue sanna", "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim", "ulrich": "uli",
    "victoria": "vicky", "vladimir": "vova", "wilhelm": "willi", "william": "bill will billy", "charles": "charlie chuck", "andrew": "andy drew",
}.items():
    for _n in _short.split():
        NICKNAMES.setdefault(_n, set()).add(_full)
FULL_NAMES = frozenset(f for fs in NICKNAMES.values() for f in fs)
TITLES = set("dr prof professor mr mrs ms phd md msc dipl ing sir".split())
GROUPS = set("consortium consort collaboration collab network netw group wg project initiative team alliance investigators committee".split())
PLACES = [("canc", "cancer"), ("neuro", "neuro"), ("chem", "chemistry"), ("med", "medicine"), ("mol", "molecular"), ("imb", "molecular"), ("imag", "imaging"), ("nli", "imaging"), ("tech", "technical"), ("tu", "technical"), ("univ", "university"), ("u", "university")]
GENERIC = set("the of for and de der di la le national natl nat laboratory lab labs laboratories institute inst institut department dept dep school sch college coll center centre ctr hub faculty fac division div biology biol hospital hosp clinic academy acad".split())
PARTICLES = set("von van der den de del di da la le el al bin ibn zu zur ten ter dos du mac mc o".split())
_MARKS = re.compile(r"[*†‡§¶#]|\b\d+(?:\s*,\s*\d+)*\b")
_MN = regex.compile(r"\p{Mn}+")
_PART = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*\.?")
SPEC = "pid long, fam string, given string, mids string, init string, aff string, orcid string"


def fold(s: str) -> str:
    return _MN.sub("", unicodedata.normalize("NFKD", s.replace("ß", "ss").replace("ø", "o").replace("ł", "l"))).lower()


def affiliation_key(a: str | None) -> str | None:
    """Kind of institution and its remaining words, whatever the order and abbreviation."""
    if not a or not a.strip():
        return None
    kinds, rest = set(), []
    for w in re.findall(r"[^\W_]+", fold(a)):
        kind = next((k for stem, k in PLACES if (w == stem if len(stem) < 3 or stem in ("nli", "imb") else w.startswith(stem))), None)
        if kind:
            kinds.add(kind)
        elif w not in GENERIC:
            rest.append(w)
    kinds -= {"university"} if len(kinds) > 1 else set()
    return f"{'+'.join(sorted(kinds))}|{' '.join(sorted(rest))}"


def _spelling(family: str) -> str:
    """A family name without the traces of transliterated umlauts and of 'm' read as 'rn'."""
    return re.sub(r"([aou])e", r"\1", family).replace("rn", "m")


def orcid_key(o: str | None) -> str | None:
    m = re.search(r"(\d{4})\D?(\d{4})\D?(\d{4})\D?(\d{3}[\dXx])(?!\d)", o) if o else None
    return "".join(m.groups()).upper() if m else None


def full_givens(g: str) -> set[str]:
    """A given name and the full names it may be short for."""
    return {g} | NICKNAMES.get(g, set())


def _is_group(toks: list[str]) -> bool:
    return len(toks) >= 2 and any(t in GROUPS or t.startswith(("consort", "collab", "netw")) for t in toks[1:]) or len(toks) >= 3 and any(len(t) > 6 and (near(t, "consortium") or near(t, "collaboration") or near(t, "network")) for t in toks[1:])


def parse_name(name: str | None, givens: frozenset[str]) -> tuple[str, str, str, str] | None:
    """(family, given or '', further initials, given initial); a consortium has given '' and initial '*'."""
    if not name or not name.strip():
        return None
    s = _MARKS.sub(" ", unicodedata.normalize("NFC", name)).replace("’", "'").strip(" ,;.")
    low = fold(s)
    toks = re.findall(r"[^\W_]+", low)
    short = re.fullmatch(r"([^\W\d_]{4,})-([A-Z]{2,3})", s)  # Head-AB, a group's short form
    if _is_group(toks) or short:
        # a group is its own word and the first letters of the next two, whatever their spelling
        core = toks[1:] if toks[0] in ("the", "teh", "hte", "te", "th") else toks
        core = [c for t in core for c in (("working", "group") if t == "wg" else (t,))]
        letters = short.group(2).lower()[:2] if short else "".join(t[0] for t in core[1:3])
        return (_spelling(core[0]) + letters, "", "", "*")
    head, comma, tail = s.partition(",")
    if comma and fold(tail).strip(" .") in TITLES:
        head, comma, tail = head, "", ""
    parts = lambda x: [p for p in _PART.findall(x) if fold(p).strip(".") not in TITLES]

    def is_initial(p: str, last: bool) -> bool:
        q = p.strip(".")
        if len(q) == 2 and last and s.isupper() and fold(q) not in givens and fold(q) not in PARTICLES:
            return True
        return len(q) == 1 or (len(q) <= 3 and q.isupper() and last and not s.isupper()) or (p.endswith(".") and len(q) <= 2) or (last and len(q) == 2 and q.islower() and s.islower() and fold(q) not in PARTICLES)

    if comma:
        fam, rest = parts(head), parts(tail)
    else:
        p = parts(s)
        if not p:
            return None
        k = len(p)
        while k > 1 and is_initial(p[k - 1], True):
            k -= 1
        if k < len(p) and not is_initial(p[0], False):
            fam, rest = p[:k], p[k:]  # Family XY
        else:
            j = 0
            while j < len(p) - 1 and is_initial(p[j], False):
                j += 1
            if j:
                fam, rest = p[j:], p[:j]  # X. Y. Family
            elif len(p) == 1:
                fam, rest = p, []
            else:
                f = [fold(x).strip(".") for x in p]
                if not any(x in givens for x in f):  # a given name with a slip
                    like = [bool(_variants(x) & _given_variants(givens)) for x in f]
                    if like[-1] and not like[0]:
                        f[-1] = next(iter(givens))
                if f[-1] in givens and f[0] not in givens:
                    cut = len(p) - 1
                    while cut > 1 and (f[cut - 1] in givens or is_initial(p[cut - 1], False)):
                        cut -= 1
                    fam, rest = p[:cut], p[cut:]
                else:
                    cut = 1
                    while cut < len(p) - 1 and (f[cut] in givens or is_initial(p[cut], False)) and f[cut] not in PARTICLES:
                        cut += 1
                    if f[0] in PARTICLES and f[0] not in givens:  # van der Family Given
                        cut = len(p) - 1
                        fam, rest = p[:cut], p[cut:]
                    else:
                        fam, rest = p[cut:], p[:cut]
    family = _spelling(re.sub(r"[^\w]|_", "", fold("".join(fam))))
    if not family:
        return None
    given, initials = "", ""
    for x in rest:
        q = re.sub(r"[^\w-]", "", fold(x))
        short = is_initial(x, True) and not (len(q) > 1 and q in givens)
        for y in q if short else [q]:
            if not y or y == "-":
                continue
            if not initials and not short and not given:
                given = y.replace("-", "")
            initials += y[0]
    return family, given, initials[1:], initials[:1]


def _variants(w: str) -> set[str]:
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} if len(w) > 3 else {w}


_GIVEN_VARIANTS: dict[int, frozenset[str]] = {}


def _given_variants(givens: frozenset[str]) -> frozenset[str]:
    got = _GIVEN_VARIANTS.get(len(givens))
    if got is None:
        got = _GIVEN_VARIANTS[len(givens)] = frozenset(v for g in givens if len(g) > 4 for v in _variants(g))
    return got


def near(a: str, b: str) -> bool:
    """At most one slip: a letter more, fewer, other, or two swapped (two slips in long names)."""
    if a == b:
        return True
    from evigraph.llm.refmatch import _distance

    most = 1 if min(len(a), len(b)) < 14 else 2
    return min(len(a), len(b)) > 3 and _distance(a, b, most) <= most


def _same_given(a: str, b: str) -> bool:
    return bool(full_givens(a) & full_givens(b)) or (len(a) > 3 and len(b) > 3 and near(a, b))


class Profile:
    __slots__ = ("cid", "fams", "givens", "mids", "inits", "affs", "orcids", "firsts")

    def __init__(self, cid: int, fams: list, givens: list, mids: list, inits: list, affs: list, orcids: list):
        self.cid, self.fams, self.givens, self.mids, self.inits, self.affs, self.orcids = cid, set(fams), {g for g in givens if g}, {m for m in mids if m}, {i for i in inits if i}, set(affs), set(orcids)
        self.firsts = self.inits | {x[0] for g in self.givens for x in full_givens(g)}

    def may_be(self, o: Profile) -> bool:
        """Nothing contradicts that both are one."""
        if self.orcids and o.orcids and not self.orcids & o.orcids:
            return False
        if ("*" in self.inits) != ("*" in o.inits):
            return False
        if self.givens and o.givens and not any(_same_given(a, b) for a in self.givens for b in o.givens):
            return False
        first, other = self.firsts, o.firsts
        if first and other and not first & other:
            return False
        return not self.mids or not o.mids or any(a.startswith(b) or b.startswith(a) for a in self.mids for b in o.mids)


def _resolve(items: list[Profile]) -> Iterator[tuple[int, int]]:
    """Links among profiles of one family at one place."""
    groups: list[list[Profile]] = []
    full = sorted((p for p in items if p.givens), key=lambda p: (not p.orcids, -len(p.mids), p.cid))
    for p in full:
        fits = [g for g in groups if all(p.may_be(q) for q in g)]
        if len(fits) == 1:
            yield (fits[0][0].cid, p.cid)
            fits[0].append(p)
        elif not fits:
            groups.append([p])
        else:  # a bare name between two that differ: the one that shares its middle initials, if only one does
            closer = [g for g in fits if any(p.mids & q.mids for q in g)] if p.mids else [g for g in fits if not any(q.mids or q.orcids for q in g)]
            if len(closer) == 1:
                yield (closer[0][0].cid, p.cid)
                closer[0].append(p)
            else:
                groups.append([p])
    short: list[list[Profile]] = []
    for p in sorted((p for p in items if not p.givens), key=lambda p: (not p.orcids, -len(p.mids), p.cid)):
        fits = [g for g in groups if all(p.may_be(q) for q in g)]
        if len(fits) > 1 and p.mids:
            fits = [g for g in fits if any(p.mids & q.mids for q in g)] or fits
        if len(fits) == 1:
            yield (fits[0][0].cid, p.cid)
        elif not fits:
            own = next((g for g in short if all(p.may_be(q) for q in g)), None)
            if own:
                yield (own[0].cid, p.cid)
                own.append(p)
            else:
                short.append([p])


def _placed(items: list[Profile]) -> Iterator[tuple[int, int]]:
    """Links of one block: families meet through shared one-deletion variants."""
    by: dict[str, list[int]] = defaultdict(list)
    parent = list(range(len(items)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[str, tuple[int, str]] = {}
    for i, p in enumerate(items):
        for f in p.fams:
            for v in _variants(f):
                seen = first.setdefault(v, (i, f))
                if seen[0] != i and near(seen[1], f):
                    parent[root(i)] = root(seen[0])
    for i in range(len(items)):
        by[root(i)].append(i)
    for members in by.values():
        if len(members) > 1:
            yield from _resolve([items[i] for i in members])


def _first_two(p: Profile, candidates: Iterator[Profile]) -> list[Profile]:
    """At most two profiles that p may be: one is a match, two are too many."""
    out: list[Profile] = []
    for q in candidates:
        if q.cid not in {x.cid for x in out} and p.may_be(q):
            out.append(q)
            if len(out) == 2:
                break
    return out


def _unplaced(items: list[Profile]) -> Iterator[tuple[int, int]]:
    """Links of profiles without affiliation to the only profile of that name, or to each other.

    Spelt-out names are looked up by their one-deletion variants, and a search ends at the second
    fit; a profile with an ORCID can only join those without, equal ORCIDs having met elsewhere.
    """
    bare = [p for p in items if not p.affs]
    if not bare:
        return
    rest = [p for p in items if p.affs]
    free = [q for q in rest if not q.orcids]
    by_given: dict[str, list[Profile]] = defaultdict(list)
    for q in rest:
        for v in {v for g in q.givens for x in full_givens(g) for v in _variants(x)}:
            by_given[v].append(q)
    left = []
    for p in bare:
        pool = free if p.orcids else rest
        spelt: list[Profile] = []
        if p.givens:
            keys = {v for g in p.givens for x in full_givens(g) for v in _variants(x)}
            spelt = _first_two(p, (q for v in keys for q in by_given.get(v, ()) if not (p.orcids and q.orcids)))
        one = spelt or _first_two(p, (q for q in pool if not (p.givens and q.givens)))
        if len(one) == 1:
            yield (one[0].cid, p.cid)
        elif not one:
            left.append(p)
    yield from _resolve(left)


def _slipped(items: list[Profile]) -> Iterator[tuple[int, int]]:
    """(profile without affiliation, profile it may be), families equal or near; at most two each, as two are too many."""
    for p in items:
        if not p.affs:
            for q in _first_two(p, (q for q in items if q.cid != p.cid and any(near(f, g) for f in p.fams for g in q.fams))):
                yield (p.cid, q.cid)


def components(links: DataFrame) -> DataFrame:
    """(cid, root) of linked ids by repeated minimum and pointer jumping; lineage cut each time."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges = checkpoint(edges)
    while True:
        # small star: every id points to the smallest id it is linked with, and so do its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        new = both.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        new = checkpoint(new)
        if new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty():
            return new.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "cid")
        edges = new


def parsed(entries: DataFrame, id_col: str, name_col: str, aff_col: str, orcid_col: str) -> DataFrame:
    """(id, fam, given, mids, init, aff, orcid) of each entry with a name."""
    spark = entries.sparkSession
    named = entries.filter(F.col(name_col).isNotNull())
    # given names: words often met after a comma; at most 1 / share of them exist
    after = named.filter(F.col(name_col).contains(",")).select(F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace(F.substring_index(name_col, ",", -1), r"[^\p{L}\s-]", " ")), r"\s+"))).alias("w")).filter(F.length("w") > 2)
    n = named.count()
    rows = after.groupBy("w").count().filter(F.col("count") >= max(3, n * 1e-4)).select("w").collect()
    known = spark.sparkContext.broadcast(frozenset(fold(r["w"]) for r in rows) | frozenset(NICKNAMES) | FULL_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, name, aff, orcid in zip(*(c.to_pylist() for c in b.columns)):
                p = parse_name(name, known.value)
                if p:
                    ids.append(i)
                    out.append((*p, affiliation_key(aff) or "", orcid_key(orcid) or ""))
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(list(c), pa.string()) for c in cols]], names=["id", "fam", "given", "mids", "init", "aff", "orcid"])

    return named.select(F.col(id_col).alias("id"), name_col, aff_col, orcid_col).mapInArrow(run, "id long, fam string, given string, mids string, init string, aff string, orcid string")


FORM = ["fam", "given", "mids", "init", "aff", "orcid"]


def resolve_entities(entries: DataFrame, id_col: str = "author_id", name_col: str = "author_name", aff_col: str = "affiliation", orcid_col: str = "orcid") -> DataFrame:
    """(id, entity): entries of one entity share the entity's number."""
    rows = checkpoint(parsed(entries.dropDuplicates([id_col]), id_col, name_col, aff_col, orcid_col))
    forms = rows.groupBy(*FORM).agg(F.min("id").alias("pid"))
    forms = checkpoint(forms.withColumn("cid", F.col("pid")))

    def post(batches: Iterator[pa.RecordBatch], slips: bool = False) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys = [], []
            for r, (fams, givens, inits, affs, orcids) in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("fams", "givens", "inits", "affs", "orcids")))):
                own = set() if slips else {f"o|{o}" for o in orcids if o}
                first = {i for i in inits if i} | {x[0] for g in givens if g for x in full_givens(g)}
                for f in fams:
                    for i in first or {""}:
                        if i == "*":
                            own |= set() if slips else {f"g|^{f[:3]}", f"g|{f[-5:]}$"}
                            continue
                        own |= set() if slips else {f"a|{a}|{i}|{e}" for a in affs if a for e in ("^" + f[:1], f[-1:] + "$")}
                        own |= {f"v|{v}|{i}" for v in _variants(f)} if slips else {f"n|{f}|{i}"}
                keys += own
                at += [r] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[c.take(pa.array(at, pa.int64())) for c in b.columns]], names=["key", *b.schema.names])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(key: str, items: list[Profile]) -> list[tuple[int, int]]:
            if len(items) < 2:
                return []
            if key[0] == "o":
                return [(items[0].cid, p.cid) for p in items[1:]]
            if key[0] == "v":
                return list(_slipped(items))
            return list(_unplaced(items) if key[0] == "n" else _placed(items))

        key, items = None, []
        for b in batches:
            found = []
            for k, *p in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    found += close(key, items) if items else []
                    key, items = k, []
                items.append(Profile(*p))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        found = close(key, items) if items else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    lists = "fams array<string>, givens array<string>, mids array<string>, inits array<string>, affs array<string>, orcids array<string>"
    while True:  # ends, as every round with a link leaves fewer profiles
        profiles = forms.groupBy("cid").agg(*[F.array_sort(F.collect_set(c)).alias(n) for c, n in (("fam", "fams"), ("given", "givens"), ("mids", "mids"), ("init", "inits"))], *[F.filter(F.collect_set(c), lambda x: x != "").alias(n) for c, n in (("aff", "affs"), ("orcid", "orcids"))])
        posted = profiles.mapInArrow(post, f"key string, cid long, {lists}").repartition("key").sortWithinPartitions("key", "cid")
        links = checkpoint(posted.mapInArrow(link, "a long, b long").filter("a != b").distinct())
        if links.isEmpty():  # then slips in names without affiliation, where one profile fits over all blocks
            posted = profiles.mapInArrow(lambda b: post(b, True), f"key string, cid long, {lists}").repartition("key").sortWithinPartitions("key", "cid")
            fits = posted.mapInArrow(link, "a long, b long").distinct().groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n"))
            links = checkpoint(fits.filter("n = 1").select("a", "b"))
        if links.isEmpty():
            break
        roots = components(links)
        forms = checkpoint(forms.join(roots, "cid", "left").select("pid", *FORM, F.coalesce("root", "cid").alias("cid")))
    return rows.join(forms.drop("pid"), FORM).select("id", F.col("cid").alias("entity"))


def entity_pairs(entries: DataFrame, **columns: str) -> DataFrame:
    """(a, b), a < b: all pairs of entries of one entity."""
    e = resolve_entities(entries, **columns)
    return e.select("entity", F.col("id").alias("a")).join(e.select("entity", F.col("id").alias("b")), "entity").filter("a < b").select("a", "b")


def summary(values: list[int]) -> Counter:
    """Sizes of entities, for reports."""
    return Counter(Counter(values).values())
