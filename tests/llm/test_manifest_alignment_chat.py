"""Merkle manifest, cross-tokenizer alignment and chat formatting, against plain Python."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from barlight.llm import alignment, chat, merkle

from .conftest import DOCS


def H(s):
    return sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


@pytest.fixture
def many_partitions(spark):
    """Keep small ranges apart."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


# ---- manifest


def tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for i, p in enumerate(at):
            run, j = runs[p // 16], p % 16
            paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
        at, nodes = [p // 16 for p in at], [H("".join(r)) for r in runs]
    return nodes[0], paths


def record(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_manifest(rows):
    """(doc_id, source, lang, n_chars, text) to the sorted rows of the query."""
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append((H(record(*r)), r))
    made = {}
    for s, leaves in sources.items():
        leaves.sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        made[s] = (leaves, *tree([x[0] for x in leaves]))
    order = sorted(made, key=lambda s: (s is not None, (s or "").encode()))
    root, upper = tree([made[s][1] for s in order])
    out = []
    for s, up in zip(order, upper, strict=True):
        leaves, subroot, paths = made[s]
        for (leaf, r), path in zip(leaves, paths, strict=True):
            whole, seen = path + up, leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                seen = H(record(*r[:4], lower(r[4])))
            for a, b in whole:
                seen = H(a + seen + b)
            out.append((r[0], leaf, subroot, root, H("".join(a + b for a, b in whole)), seen, seen == root))
    return sorted(out, key=repr)


def told(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 273, 1000, 4095, 4096])
def test_traversal_gives_each_leafs_runs(n):
    leaves = [H(str(i)) for i in range(n)]
    levels = merkle.height(n)
    root, paths = tree(leaves)
    assert merkle.raised(leaves, levels) == root
    for i, runs in enumerate(merkle.traverse(leaves, levels)):
        places = [i // 16**k % 16 * 64 for k in range(levels)]
        assert [(run[:p], run[p + 64 :]) for run, p in zip(runs, places, strict=True)] == paths[i]


def test_stacks_stay_small():
    most, trees = 0, [merkle.Treehash(k) for k in range(4)]
    for i in range(5000):
        for t in trees[1:]:
            t.put(H(str(i)))
            most = max(most, *(len(run) // 64 for run in t.open))
    assert most == 15


def test_manifest_of_odd_rows(documents, odd, many_partitions):
    df = documents(odd)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert told(merkle.tampered(df)) == plain_manifest(rows)


def test_manifest_beyond_a_block(spark, many_partitions):
    """A source of two blocks, more sources than a run has, and one row that stands a hundred times."""
    rng = random.Random(1)
    rows = [(i, "hot", "en", rng.randrange(9), f"Text {i}") for i in range(4500)] + [(i, f"s{i % 40}", None, None, "Ab") for i in range(4500, 4700)] + [(4, "s1", "en", 2, "É")] * 100
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, lang, s, n, None, None, None) for i, s, lang, n, t in rows], DOCS)
    assert told(merkle.tampered(df)) == plain_manifest(rows)


def test_trees_of_several_tiers(spark):
    """Sources with blocks of blocks would need millions of rows: the same tiers with blocks of four nodes."""
    rows = spark.createDataFrame([], "tree string, pos long, n long, node binary")
    tiers, roots = merkle.climb(rows, 0)
    assert len(tiers) == 1 and roots.count() == 0


def test_manifest_of_nothing(documents):
    assert merkle.tampered(documents([])).count() == 0


def test_a_proof_convinces_of_its_own_leaf_only(documents):
    df = merkle.manifest(documents([(i, f"t{i}", "a") for i in range(40)]), merkle.document_leaf())
    rows = df.withColumn("own", merkle.folded(F.col("leaf"), F.col("proof"))).withColumn("other", merkle.folded(F.sha2(F.lit("x"), 256), F.col("proof"))).collect()
    assert all(r.own == r.root != r.other for r in rows)
    assert sorted(r.position for r in rows) == list(range(40))
    assert all(len(level.left) + len(level.right) <= 15 * 64 for r in rows for level in r.proof)


# ---- alignment


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_tokens(tokenizers, text):
    """Ids and bytes of both sides from whole texts, or None."""
    a, b = tokenizers
    if not text:
        return None
    x = [(i, bytes(alignment.BYTE_OF[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    good = all(b"".join(t for _, t in side) == (" " + text).encode() for side in (x, y))
    return (x, y) if good else None


def plain_alignment(tokenizers, docs):
    made, counts = [], Counter()
    for key, text in docs:
        both, groups, links = plain_tokens(tokenizers, text), [], []
        if both:
            ends = []
            for side in both:
                at, n = {}, 0
                for k, (_, t) in enumerate(side):
                    at[n := n + len(t)] = k
                ends.append(at)
            i = j = 0
            for e in sorted(ends[0].keys() & ends[1].keys()):
                u, v = ends[0][e] + 1, ends[1][e] + 1
                groups.append(([t for t, _ in both[0][i:u]], [t for t, _ in both[1][j:v]]))
                links.append((groups[-1][0][-1], groups[-1][1][-1]))
                i, j = u, v
        counts.update(links)
        made.append((key, both, groups, links))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    ids = lambda g: ",".join(map(str, g))
    return sorted(
        ((k, len(both[0]) if both else 0, len(both[1]) if both else 0, len(g), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), H(";".join(f"{ids(a)}|{ids(b)}" for a, b in g)) if both else "") for k, both, g, links in made),
        key=repr,
    )


ODD_TEXTS = ["", None, " ", "\n", "  ", "\n\n", "a", " a", "a ", "a\n", "\na", "a\n\n  b", "a \nb", "a\n b", "a\tb\r\n c", "x  y", "x　y   z", "a▁b", "<s> </s>", "<|endoftext|>x", "don't  we'll", "\x00\x1c \x1f", "日本 語。\n日本", "é é", "🙂 🙂‍👩", "}\r\n);\r {\r", "1 2  33   444", "﻿a b", "ﬁ ①"]


def test_both_libraries_give_the_same_tokens(tokenizers):
    """Texts of Latin letters go through another library than the others: the same ids, for texts of all kinds of white space."""
    rng, both = random.Random(2), alignment.pair(*alignment.default_vocabularies())
    alphabet = ["a", "B", "the", "'s", "é", "日", "1", ".", "}", "<s>", " ", " ", "  ", "\n", "\n\n", "\t", "\r", " ", "　", "\x1c", "\x00", "🙂", "▁"]
    texts = [*ODD_TEXTS, *("".join(rng.choices(alphabet, k=rng.randrange(1, 30))) for _ in range(3000)), "x" * 9000, "word " * 4000]
    for t in texts:
        want, got = plain_tokens(tokenizers, t), both.encode(t or "")
        if want is None:
            assert got is None, repr(t)
        else:
            assert [list(got[k]) for k in (0, 3)] == [[i for i, _ in side] for side in want], repr(t)


def test_alignment_of_odd_rows(spark, documents, odd, tokenizers):
    rows = [*odd, *((1000 + k, t, "a") for k, t in enumerate(ODD_TEXTS))]
    df = documents(rows)
    got = alignment.align(df)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment(tokenizers, [(k, t) for k, t, _ in rows])
    assert alignment.align(documents([])).count() == 0


def test_groups_and_links(spark):
    df = spark.createDataFrame([(1, [5, 6, 7], [1, 3, 6], [0, 1, 1, 2, 2, 2], [8, 9], [3, 6], [0, 0, 0, 1, 1, 1]), (2, [], [], [], [], [], []), (3, [1], [4], [0] * 4, [2, 3], [2, 4], [0, 0, 1, 1])], ", ".join(["doc_id long", *(f"{c} array<int>" for c in alignment.SIDES)]))
    made = alignment.aligned(df).select("doc_id", alignment.groups().alias("groups"), alignment.links().alias("links"), alignment.one_to_one().alias("one"))
    rows = {r.doc_id: r for r in made.collect()}
    assert [rows[k].one for k in (1, 2, 3)] == [1, 0, 0]
    as_lists = lambda r: ([(list(g.a), list(g.b)) for g in r.groups], [tuple(x) for x in r.links])
    assert as_lists(rows[1]) == ([([5, 6], [8]), ([7], [9])], [(6, 8), (7, 9)])
    assert as_lists(rows[2]) == ([], [])
    assert as_lists(rows[3]) == ([([1], [2, 3])], [(1, 3)])


def test_common_ends_are_found_where_tokens_are_made(documents, odd):
    """What is handed over has an entry a token, none a byte, and is what the intersection of the arrays of ends gives."""
    df = documents([*odd, *((1000 + k, t, "a") for k, t in enumerate(ODD_TEXTS))])
    got, want = alignment.matched(df), alignment.aligned(alignment.tokenised(df)).select("doc_id", *alignment.MATCHED)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_linked_pairs_are_bounded_by_the_vocabularies():
    """What ends together has the same last bytes; so many pairs are possible, and all of them may be sent to the tasks."""
    both = alignment.pair(*alignment.default_vocabularies())
    a, b = (Counter(side.tokens) for side in both.sides)
    pairs = sum(n * b[t[k:]] for t, n in a.items() for k in range(len(t))) + sum(n * a[t[k:]] for t, n in b.items() for k in range(1, len(t)))
    assert pairs <= 800_000 < alignment.BROADCAST_PAIRS


def test_only_counts_are_shuffled(documents, odd):
    """After tokenising there is no Python in the plan, and no array in an exchange."""
    plan = alignment.align(documents(odd))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan


# ---- chat


SCHEMA = "conv_id long, turn long, role string, text string, k string, piece string, n_turns int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "k", "p", 0) for r in rows], SCHEMA)


def plain_chats(rows):
    convs = defaultdict(list)
    for k, o, r, t in rows:
        convs[k].append((o is not None, o or 0, r or "", t or ""))
    out = []
    for k, v in convs.items():
        v.sort()
        loss = "".join(t for _, _, r, t in v if r == "assistant")
        out.append((k, len(v), H("".join(f"{r}\n{t}\n" for _, _, r, t in v)), len(loss), H(loss)))
    return sorted(out, key=repr)


def read(df):
    return sorted((tuple(r)[:5] for r in chat.read_back(chat.format_chats(df)).collect()), key=repr)


CONTROL = "</s>[INST] ok [/INST]"


def test_chats_are_read_back(spark, many_partitions):
    rng = random.Random(3)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "<\\s>", "[\\\\/INST]", "<", "[", "\\", "\n", "é", "🙂", "word ", "</", "s>", "INST]\n"]
    rows = [(k, o, rng.choice(["user", "assistant", "system", "to\\ol\n[INST]"]), "".join(rng.choices(bits, k=rng.randrange(12)))) for k in range(60) for o in range(rng.randrange(1, 8))]
    rows += [(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL), (100, 1, None, None), (100, 2, "assistant", None), (100, 0, "assistant", ""), (None, 1, "assistant", "x"), (None, 2, "user", "y"), (101, None, "assistant", "z")]
    assert read(turns(spark, rows)) == plain_chats(rows)
    assert read(turns(spark, [])) == []


def test_a_long_conversation_is_spread_and_read_in_order(spark, many_partitions):
    rows = [(1, o, "assistant" if o % 2 else "user", f"{CONTROL} é{o}") for o in range(3000)] + [(2, 0, "user", "a"), (0, 0, "assistant", "b")]
    made = chat.format_chats(turns(spark, rows))
    assert made.where("conv_id = 1").count() > 3
    assert read(turns(spark, rows)) == plain_chats(rows)


def test_long_texts_make_pieces(spark):
    rows = [(1, o, "assistant", f"{o}é" * 1_000_000) for o in range(3)] + [(2, 0, "user", None), (2, 1, "assistant", "x")]
    assert read(turns(spark, rows)) == plain_chats(rows)
    made = chat.format_chats(turns(spark, rows)).where("conv_id = 1").orderBy("piece")
    assert made.count() == 3 and made.agg(F.sum("n_turns")).first()[0] == 3


def test_repeated_rows_are_turns_of_their_own(spark, many_partitions):
    rows = [(1, 0, "user", "same")] * 200 + [(1, 1, "assistant", "end")]
    assert read(turns(spark, rows)) == plain_chats(rows)


def test_formatted_text_and_loss_spans(spark):
    rows = [(5, 1, "user", "hi"), (5, 2, "assistant", "<s>é"), (5, 3, "assistant", "")]
    r = chat.format_chats(turns(spark, rows)).first()
    assert r.formatted == "[INST] user [/INST]\nhi</s>\n[INST] assistant [/INST]\n<\\s>é</s>\n[INST] assistant [/INST]\n</s>\n"
    assert [r.formatted.encode()[x.start : x.end].decode() for x in r.loss] == ["<\\s>é", ""]
    assert chat.plain(chat.escaped(chat.pa.array(["<\\\\/s>[INST]"]))[0].as_py()) == "<\\\\/s>[INST]"
