"""Samples of scored rollouts: masked labels, verified labels, limits."""

import random

import pytest
from pyspark.sql import functions as F

from trailspark.operators import branches, rollout, routing

SCHEMA = f"rollout_id long, truncated boolean, note string, {rollout.ROLLOUT}"


def ids(text):
    return [ord(c) for c in text]


def sample(tokens):
    return (tokens, [False, *[True] * (len(tokens) - 1)], [0.0] * len(tokens), [])


def chain(*nodes):
    return [(i - 1 if i else None, *n) for i, n in enumerate(nodes)]


def scored(spark, rows_, **options):
    df = spark.createDataFrame(rows_, SCHEMA).repartition(3)
    return sorted(rollout.score(df, **options).collect(), key=lambda r: (r.rollout_id, r["sample"]))


def test_labels_are_masked_and_verified_labels_are_trained(spark):
    content, bare, user = "<PREDICTION>PASS</PREDICTION>\n<DECISION>KEEP</DECISION>", "<PREDICTION>RUNTIME_ERROR</PREDICTION>", "<PREDICTION>TIMEOUT</PREDICTION>"
    twice = "<PREDICTION> PASS </PREDICTION> then <PREDICTION>OTHER</PREDICTION>"
    nodes = chain(("user", user, False, ids(user)), ("assistant", content, True, [99, *ids(content)]), ("assistant", user, False, ids(user)), ("assistant", bare, True, [55, *ids("RUNTIME_ERROR"), 56]), ("assistant", twice, True, ids(twice)))
    tokens = [t for n in nodes for t in n[4]]
    target = ([("user", "problem  \n"), ("", "left out")], "PASS", "ASSERTION_FAILURE")
    rows_ = [
        (1, False, "clash", "arm-b", nodes, [sample(tokens), sample([1, 2])], [target]),
        (2, None, "clash", "arm-a", chain(("assistant", "no label", True, ids("no label"))), [sample(ids("no label"))], None),
        (3, True, "clash", "arm-b", nodes, [sample(tokens)], [target]), (4, False, None, None, [], [], []),
    ]
    got = scored(spark, rows_, truncated="truncated", alpha=0.25)
    assert [(r.rollout_id, r["sample"], r.kind, r.env_name) for r in got] == [(1, 0, "rollout", "arm-b"), (1, 1, "rollout", "arm-b"), (1, 2, "verified", "arm-b"), (2, 0, "rollout", "arm-a")]
    own, other, verified, plain = got
    at = [len(user) + 1 + content.index("PASS") + i for i in range(4)]
    start = len(user) + 1 + len(content) + len(user)
    at += range(start + 1, start + 1 + len("RUNTIME_ERROR"))
    start += len("RUNTIME_ERROR") + 2
    at += [start + twice.index(x) + i for x in ("PASS", "OTHER") for i in range(len(x))]
    assert own.rl_weights == [0.0 if i in at or i == 0 else 1.0 for i in range(len(tokens))] and own.token_ids == tokens
    assert other.rl_weights is None and plain.rl_weights is None and own.ce_weights is None
    text = "<|im_start|>user\nproblem\n<|im_end|>\n\n<|im_start|>assistant\n<PREDICTION>ASSERTION_FAILURE</PREDICTION>"
    assert verified.token_ids == ids(text) and verified.temperatures == [] and set(verified.mask) == {False} and set(verified.rl_weights) == set(verified.logprobs) == {0.0}
    low = text.index("ASSERTION_FAILURE")
    assert verified.ce_weights == [0.25 if low <= i < low + len("ASSERTION_FAILURE") else 0.0 for i in range(len(text))]


def test_tokens_that_straddle_a_label_count(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    # pieces of three characters of anything
    words = Tokenizer(models.WordLevel({"[UNK]": 0, "<PR": 1, "EDI": 2, "CTI": 3, "ON>": 4, "PAS": 5, "S</": 6}, unk_token="[UNK]"))
    from tokenizers import Regex

    words.pre_tokenizer = pre_tokenizers.Split(Regex(".{1,3}"), "isolated")
    words.save(f"{tmp_path}/pieces.json")
    encode = rollout.file_tokens(f"{tmp_path}/pieces.json")
    said = "<PREDICTION>PASS</PREDICTION>"
    read = spark.createDataFrame([(said,)], "t string").select(encode(F.col("t")).alias("x")).first().x
    found = [t.id for t in read]
    assert found[:6] == [1, 2, 3, 4, 5, 6] and (read[5].start, read[5].end) == (15, 18)
    got = scored(spark, [(1, False, None, "b", chain(("assistant", said, True, found)), [sample(found)], [([], "PASS", "PASS")])], encode=encode)
    assert got[0].rl_weights[4:6] == [0.0, 0.0] and sum(got[0].rl_weights) == len(found) - 3
    assert [x for x in got[1].ce_weights if x] == [0.1, 0.1]


def test_a_label_that_branches_share_is_hidden_in_each(spark):
    """root - a label - two ends; a branch without a sampled node has no sample; the middle of the tree is no branch."""
    said, end = "x <PREDICTION>PASS</PREDICTION>", "<PREDICTION>\n OTHER</PREDICTION>"
    nodes = [
        (None, "system", "s", False, [7]), (0, "assistant", said, True, ids(said)), (1, "tool", "t", False, [8, 8]), (2, "assistant", end, True, ids(end)), (1, "user", "u", False, [9]),
        (0, "user", "never sampled", False, [1]),
    ]
    first, second = [7, *ids(said), 8, 8, *ids(end)], [7, *ids(said), 9]
    got = scored(spark, [(1, False, None, "b", nodes, [sample(first), sample(second), sample([5])], [])])
    hidden = {0: [1 + said.index("PASS") + i for i in range(4)]}
    hidden[1] = hidden[0]
    hidden[0] = hidden[0] + [1 + len(said) + 2 + end.index("OTHER") + i for i in range(5)]
    for r, tokens in zip(got[:2], (first, second), strict=True):
        assert r.rl_weights == [0.0 if i == 0 or i in hidden[r["sample"]] else 1.0 for i in range(len(tokens))]
    assert got[2].rl_weights is None


@pytest.mark.parametrize(
    ("row", "options", "message"),
    [
        ((1, False, None, "b", chain(("assistant", "<PREDICTION>PASS</PREDICTION>", True, ids("<PREDICTION>PASS</PREDICTION>"))), [sample([1, 2, 3])], []), {}, "outside its sample"),
        ((1, False, None, "b", [], [], [([("user", "x" * 50)], None, "PASS")]), {"max_tokens": 60}, "the limit is 60"),
        ((1, False, None, "b", [], [], [([("user", "x")], None, "MAYBE")]), {}, "outcome class"), ((1, False, None, "b", [], [], [(None, None, "PASS")]), {}, "context messages"),
        ((1, False, None, "b", chain(("assistant", "x", True, [1])), [], []), {}, "no sample"),
    ],
)
def test_broken_rollouts_are_errors(spark, row, options, message):
    with pytest.raises(Exception, match=message):
        scored(spark, [row], **options)


def test_options_are_checked(spark):
    for options in ({"alpha": 0.0}, {"max_tokens": 0}):
        with pytest.raises(ValueError, match="alpha"):
            rollout.score(spark.createDataFrame([], SCHEMA), **options)
    assert rollout.score(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_paths(rows):
    up = {(t, n): p for t, n, p in rows}
    inner = {(t, p) for t, _, p in rows if p is not None}
    out = []
    for t, n in up:
        if (t, n) not in inner:
            path, at = [], n
            while at is not None:
                path.append(at)
                at = up[t, at]
            out += [(t, n, i, x) for i, x in enumerate(reversed(path))]
    return sorted(out, key=repr)


def paths_of(spark, rows):
    df = spark.createDataFrame(rows, "tree string, node long, parent long").withColumn("leaf", F.lit("clash")).withColumn("place", F.lit("clash"))
    return sorted(map(tuple, branches.branch_paths(df, ["tree"]).collect()), key=repr)


def test_paths_are_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("wide", i, None if i == 0 else rng.randrange(max(0, i - 3), i)) for i in range(120)]
    rows += [(None, i, None if i % 5 == 0 else i - 1) for i in range(17)] + [("one", 4, None)]
    rows += [("star", i, None if i == 0 else 0) for i in range(40)]
    cuts, plain = [], branches.cut
    monkeypatch.setattr(branches, "cut", lambda df: cuts.append(1) or plain(df))
    assert paths_of(spark, rows) == brute_paths(rows)
    chain_ = [("deep", i, None if i == 0 else i - 1) for i in range(300)]
    cuts.clear()
    rng.shuffle(chain_)
    assert paths_of(spark, chain_) == brute_paths(chain_)
    assert len(cuts) <= 2 + 2 * 9  # nine rounds reach 300 nodes
    assert paths_of(spark, []) == []


@pytest.mark.parametrize(
    ("rows", "message"),
    [([("t", 0, None), ("t", 1, 7)], "no node"), ([("t", 0, None), ("t", 0, None)], "2 times"), ([("t", 0, 1), ("t", 1, 2), ("t", 2, 0)], "cycle"), ([("t", 0, None), ("t", 1, 2), ("t", 2, 1), ("t", 3, 1)], "cycle"), ([("t", None, None)], "given")],
)
def test_broken_links_are_errors(spark, rows, message):
    with pytest.raises(ValueError, match=message):
        paths_of(spark, rows)


def test_places_are_brute_force(spark):
    rng = random.Random(1)
    data = [tuple([rng.randint(0, 2) for _ in range(rng.randint(0, n))] for n in (12, 4)) for _ in range(300)]
    got = spark.createDataFrame(data, "xs array<int>, part array<int>").select("xs", "part", routing.find_subsequence(F.col("xs"), F.col("part")).alias("at")).collect()
    for r in got:
        assert r.at == (next((i for i in range(len(r.xs) - len(r.part) + 1) if r.xs[i : i + len(r.part)] == r.part), None) if r.part else None)


def test_labels_are_a_list_a_node_and_query_joins_nothing(spark):
    said = "a <PREDICTION>PASS</PREDICTION> b <PREDICTION> OTHER </PREDICTION>"
    rows = [(1, 0, "assistant", said, True, [7, *ids(said)]), (1, 1, "assistant", said, False, ids(said)), (1, 2, "user", said, True, ids(said)), (None, 0, "assistant", "none", True, ids("none")), (2, 0, "assistant", None, True, None), (2, 1, "assistant", said, True, [1, 2])]
    df = spark.createDataFrame(rows, "rollout long, node int, role string, content string, sampled boolean, token_ids array<int>").repartition(3)
    got = {(r.rollout, r.node): r.places for r in rollout.hidden_places(df).collect()}
    hidden = [1 + said.index(x) + i for x in ("PASS", "OTHER") for i in range(len(x))]
    assert got == {(1, 0): hidden, (1, 1): [], (1, 2): [], (None, 0): [], (2, 0): [], (2, 1): []}
    from trailspark.plans import queries

    plan = queries.QUERIES["label_token_mask"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_weights_are_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(200):
        n = rng.randint(1, 12)
        rows.append(([rng.random() < 0.7 for _ in range(n)], [rng.randrange(n) for _ in range(rng.randint(0, n))]))
    df = spark.createDataFrame(rows, "mask array<boolean>, hidden array<int>")
    got = df.select("mask", "hidden", rollout.weights(F.col("mask"), F.col("hidden")).alias("w")).collect()
    for r in got:
        assert r.w == ([float(keep and i not in r.hidden) for i, keep in enumerate(r["mask"])] if r.hidden else None)


def test_no_tree_is_broadcast(spark, monkeypatch):
    plans, plain = [], branches.cut
    monkeypatch.setattr(branches, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    nodes = [("t", i, None if i == 0 else i // 2, i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, sampled boolean")
    found = branches.trainable(branches.branch_paths(df, ["tree"]), df, ["tree"])
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)
    up = {n: p for _, n, p, _ in nodes}
    leaf = max(up)
    path = [leaf]
    while up[path[-1]] is not None:
        path.append(up[path[-1]])
    assert [r.node for r in sorted(found.where(F.col("leaf") == leaf).collect(), key=lambda r: r.place)] == path[::-1]


def test_nodes_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf(f"array<{rollout.NODE}>")
    def counted(nodes):
        made.add(1)
        return nodes

    said = "<PREDICTION>PASS</PREDICTION>"
    df = spark.createDataFrame([(1, False, None, "b", chain(("assistant", said, True, ids(said))), [sample(ids(said))], None)], SCHEMA)
    got = rollout.score(df.withColumn("nodes", counted("nodes"))).collect()
    assert sum(got[0].rl_weights) == len(said) - 5 and made.value <= 2  # once, and once where Spark looks for empty lists
