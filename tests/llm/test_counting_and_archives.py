"""Collocations, archives and the prefix trie against plain Python."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs
import pytest

from labelgrid.llm import conversation_trie, phrases, warc
from labelgrid.llm.queries import QUERIES

from . import brute

DATA = "/root/testdata/sf0.001"


def same(frame, columns, expected):
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert order(frame.select(*columns).collect()) == order(expected)


# Collocations


def mine(docs, min_count=30, top=2000, cover=80):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        often, ranked = {p: a for p, a in f.items() if a >= min_count and len(p) > 1}, []
        for p, a in often.items():
            longer = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= cover * a for b in longer):
                continue
            cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            ranked.append((" ".join(p), a, left, right, total[lang], score))
        ranked.sort(key=lambda x: (-x[-1], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(ranked[:top])]
    return out


PHRASE_COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def chatter():
    rnd = random.Random(8)
    words = ["The", "cat", "sat", "on", "mat", "é", "中文", "a\x0bb", "x" * 300, "İ"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\t", ", ", ".", "\r\n", "\x0c", " ", " "]) for _ in range(n))
    rows = [(rnd.choice(["en", "fr", None, "und"]), text(rnd.randint(0, 60))) for _ in range(60)]
    rows += [("en", "of the people by the people " * 5)] * 4 + [("de", "nur einmal hier"), ("en", None), (None, ""), ("", "ha ha ha ha ha ha"), ("en", text(20000))]
    return rows


@pytest.mark.parametrize("least, top, room", [(5, 2000, phrases.ROOM), (2, 7, phrases.ROOM), (3, 2000, 8)])
def test_collocations(spark, monkeypatch, least, top, room):
    if room < 10:
        monkeypatch.setattr(phrases, "BURST", 4)  # containers burst to the last level, subtrees are put out again and again
    docs = chatter()
    frame = spark.createDataFrame([(lang, text, "x", 1) for lang, text in docs], "lang string, text string, n string, rank int").repartition(3)
    found = phrases.collocations(frame, least, top, room=room)
    expected = mine(docs, least, top)
    assert len(expected) > 20
    same(found, PHRASE_COLUMNS, expected)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")).count() == 0


def test_words_with_one_id_take_another_seed(spark, monkeypatch):
    """Ids that clash under the first seed: all words would be one."""
    docs = spark.createDataFrame([("en", "p q p q r")] * 3, "lang string, text string")
    asked, real = [], phrases.count_words

    def clashing(frame, seed=0):
        asked.append(seed)
        made = real(frame, seed)
        return made if seed else made.withColumn("id", made["id"] * 0 + 5)

    monkeypatch.setattr(phrases, "count_words", clashing)
    same(phrases.collocations(docs, 2), PHRASE_COLUMNS, mine([("en", "p q p q r")] * 3, 2))
    assert asked == [0, 1]


def test_phrase_trie_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 16)
    rnd = np.random.default_rng(3)
    keys = rnd.integers(1, 1 << 63, 40).astype(np.uint64)[rnd.integers(0, 40, (3000, 3))]
    keys[:800, 0] = keys[0, 0]
    trie, expected, spilt = phrases.PhraseTrie(3), Counter(map(tuple, keys.tolist())), Counter()
    for part in np.array_split(keys, 7):
        trie.add(part)
        node = max(trie.subtrees(), key=lambda n: n.size())
        rows, counts = trie.take(node)
        assert rows.tolist() == sorted(rows.tolist())
        spilt.update(dict(zip(map(tuple, rows.tolist()), counts.tolist())))
        assert trie.size == trie.root.size()
    assert trie.root.children is not None
    for node in trie.subtrees():
        rows, counts = trie.take(node)
        spilt.update(dict(zip(map(tuple, rows.tolist()), counts.tolist())))
    assert spilt == expected and trie.size == 0


# Archives


def archived(pages, least=0):
    top = {}
    for page, html in pages:
        top[html or ""] = max((x for x in (top.get(html or ""), page) if x is not None), default=None)
    out, seen = [], set()
    for page, html in pages:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = len(data) < least or (page == top[html or ""] and (page, html or "") not in seen)
        seen.add((page, html or ""))
        out.append((page, len(data), digest, "response" if first else "revisit", None if first else top[html or ""]))
    return out


PAGE_COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def some_pages():
    rnd = random.Random(4)
    rows = [(i, f"http://h/{i}?q=a b\r\nX: é", "<p>" + "w" * rnd.randint(0, 3000) + str(rnd.random())) for i in range(60)]
    rows += [(100 + i, None, "copy") for i in range(40)] + [(7, "http://x", "copy"), (5, None, None), (6, "", ""), (None, "http://n", "copy"), (None, None, "only nameless"), (None, None, "only nameless")]
    rows += [(139, "http://again", "copy"), (-3, "u", "WARC/1.1\r\n\r\nx"), (200, "u", "é\x00\r\n\r\n" * 20000), (201, "u", "<html>")]
    return rows


@pytest.mark.parametrize("least, roll", [(0, warc.ROLL_BYTES), (5, 3000)])
def test_archives(spark, tmp_path, monkeypatch, least, roll):
    monkeypatch.setattr(warc, "shard_count", lambda total: 5)
    rows = some_pages()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    folders = [f"{tmp_path}/a", f"{tmp_path}/b"]
    for folder, table in zip(folders, (frame, frame.repartition(7))):
        warc.write(table, folder, min_revisit=least, roll_bytes=roll)
    found = warc.read(spark, folders[0])
    same(found, PAGE_COLUMNS, archived([(p, h) for p, _, h in rows], least))
    bodies = {(r["page_id"], bytes(r["payload"]).decode()) for r in found.where("record_type = 'response'").collect()}
    assert bodies == {(p, h or "") for (p, _, h), e in zip(rows, archived([(p, h) for p, _, h in rows], least)) if e[3] == "response"}
    # The same rows in other partitions give the same files.
    manifest = lambda f: sorted(map(tuple, spark.read.parquet(f"{f}/manifest").collect()))
    assert manifest(folders[0]) == manifest(folders[1]) and len(manifest(folders[0])) >= (3 if roll > 3000 else 6)
    names = {i.base_name for i in pyarrow.fs.LocalFileSystem().get_file_info(pyarrow.fs.FileSelector(folders[0]))}
    assert names == {r[0] for r in manifest(folders[0])} | {"manifest"}
    uris = {r["target_uri"] for r in found.collect()}
    assert "http://h/1?q=a%20b%0D%0AX:%20%C3%A9" in uris and None in uris
    whole = gzip.open(f"{folders[0]}/{manifest(folders[0])[0][0]}").read()
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and whole.endswith(b"\r\n\r\n")


def test_archives_of_nothing_and_broken_ones(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(none, f"{tmp_path}/none")
    assert warc.read(spark, f"{tmp_path}/none").count() == 0
    warc.write(spark.createDataFrame([(1, "u", "some text")], none.schema), f"{tmp_path}/one")
    name = spark.read.parquet(f"{tmp_path}/one/manifest").first()["name"]
    data = open(f"{tmp_path}/one/{name}", "rb").read()
    plain = gzip.decompress(data)
    open(f"{tmp_path}/one/{name}", "wb").write(gzip.compress(plain.replace(b"some text", b"SOME text"), mtime=0))
    with pytest.raises(Exception, match="another size|differs from its digest"):
        warc.read(spark, f"{tmp_path}/one").collect()
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records(pyarrow.BufferReader(data[:-5])))


# Conversations


def nodes(turns, family=20, heads=4):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    lists = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, x in lists.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (c % family if c >= 0 else -(-c % family))
        made[c] = tuple(lists.get(base, [])[:h] + x[h:])
    members = defaultdict(list)
    for c, x in made.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    children = Counter(x[:-1] for x in members if x)
    leaves, saved = Counter(), Counter()
    for x, who in members.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += not children[x]
            saved[x[:d]] += (len(who) - 1) * len(brute.words(x[-1][1])) if x else 0
    ends = lambda x: brute.sha(",".join(str(c) for c in sorted(c for c in members[x] if made[c] == x)))
    return [(min(w), len(x), min(members[x[:-1]]) if x else None, len(w), children[x], leaves[x], saved[x], ends(x)) for x, w in members.items()]


NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talk():
    rnd = random.Random(9)
    say = ["hi", "hi there", "", None, "what now\t?", "é 中", "tell me more " * 200]
    rows = []
    for conv in [*range(0, 90), *range(-45, -30), 10**12, 10**12 + 7]:
        for turn in range(rnd.randint(1, 6)):
            rows.append((conv, turn, rnd.choice(["user", "user", None]), rnd.choice(say[:4] if turn < 2 else say)))
    # Conversations without turns of their own, unordered and repeated turns, a long one, copies.
    rows += [(1000 + i, t, "user", f"copy {t}") for i in range(0, 4000, 20) for t in range(3)]
    rows += [(127, 0, "user", "only one"), (7000, None, "user", "null turn"), (7000, None, "bot", "null too"), (7000, 1, "a", "b"), (7000, 1, "a", "b"), (None, 1, "x", "y"), (None, None, None, None)]
    rows += [(9000, t, "user", f"turn {t % 7}") for t in range(900)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns", [conversation_trie.TURNS, 20, 1])
def test_conversation_trie(spark, monkeypatch, turns):
    monkeypatch.setattr(conversation_trie, "TURNS", turns)  # blocks of any size: nodes over edges are summed up
    monkeypatch.setattr(conversation_trie, "ID_BITS", 6)
    rows = talk()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, depth int").repartition(3)
    same(conversation_trie.conversation_trie(frame), NODE_COLUMNS, nodes(rows))


def test_conversations_as_they_stand(spark):
    rows = talk()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same(conversation_trie.trie(conversation_trie.paths(frame)), NODE_COLUMNS, nodes(rows, family=1, heads=1))


def test_conversation_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.conversation_trie(none).count() == 0
    assert conversation_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], none.schema)).count() == 0
    turnless = spark.createDataFrame([(27, 0, "a", "b")], none.schema)
    same(conversation_trie.conversation_trie(turnless), NODE_COLUMNS, nodes([(27, 0, "a", "b")]))


def test_queries_of_the_smallest_tables(spark):
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    same(QUERIES["op11_collocations"](spark, DATA), PHRASE_COLUMNS, mine(docs))
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    same(QUERIES["op12_warc"](spark, DATA), PAGE_COLUMNS, archived(pages))
    turns = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(QUERIES["op13_conversation_trie"](spark, DATA), NODE_COLUMNS, nodes(turns))
