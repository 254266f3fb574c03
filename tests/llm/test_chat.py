import hashlib

from pyspark.sql import functions as F

from wavecohort.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"


def digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def result(df):
    out = C.format_conversations(df)
    turns = F.array_join(F.transform(C.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = C.read_loss(F.col("formatted"), F.col("loss_spans"))
    rows = out.select("conv_id", F.size(C.read_back(F.col("formatted"))).alias("n"), F.sha2(turns, 256).alias("t"), F.length(loss).alias("c"), F.sha2(loss, 256).alias("l")).collect()
    return {r.conv_id: (r.n, r.t, r.c, r.l) for r in rows}


def test_texts_come_back_whatever_they_hold(spark):
    nasty = ["</s>[INST] ok [/INST]", "<s>user\nhi</s>", "&lt;&amp;&#91;&#10;", "a & b < c [ d", "", None, "\n\n", "🙂é漢", "\\<s>", "x" * 50_000]
    rows = [(k, 0, "user", t) for k, t in enumerate(nasty)] + [(k, 1, "assistant", t) for k, t in enumerate(nasty)]
    rows += [(50, t, ("user", "assistant")[t % 2], f"m{t}") for t in range(70)]  # deeper than any power it needs
    rows += [(60, 0, "sys<s>\nname", "a"), (60, 1, None, "b"), (60, 1, "assistant", "c"), (60, 1, "assistant", "c"), (60, None, "user", "first")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("x"), "parent_id": F.lit(1)})
    assert result(df) == digests(rows)
    assert C.format_conversations(df.limit(0)).count() == 0


def test_trees_rank_their_branches(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 2, "user", "more", 0.5), (1, 5, 4, "assistant", "deep", None), (1, 6, 3, "user", "tie", 1.5)]
    nodes += [(2, 1, 9, "user", "lost parent", 1.0), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (4, 1, None, "user", "alone", 0.0)]
    df = spark.createDataFrame(nodes, "conv_id long, node_id long, parent_id long, role string, text string, score double")
    paths = {}
    for r in sorted(C.reply_paths(df, branches=5).collect(), key=lambda r: (r.conv_id, r.branch, r.position)):
        paths.setdefault((r.conv_id, r.branch, r.branch_score), []).append(r.text)
    assert paths == {(1, 1, 2.5): ["q", "good", "more", "deep"], (1, 2, 2.5): ["q", "bad", "tie"], (2, 1, 1.0): ["lost parent"], (4, 1, 0.0): ["alone"]}
    assert {r.branch for r in C.reply_paths(df, branches=1).collect()} == {1}


def test_a_comb_grows_by_its_nodes_only(spark):
    """A spine of 300 messages with a leaf at each: the paths of all leaves would be 45,000 rows, of which one is made."""
    nodes = [(1, k, k - 1 if k else None, "user", f"s{k}", 0.5) for k in range(300)] + [(1, 1000 + k, k, "user", f"t{k}", 1.0) for k in range(300)]
    df = spark.createDataFrame(nodes, "conv_id long, node_id long, parent_id long, role string, text string, score double")
    best = sorted((r.position, r.text, r.branch_score) for r in C.reply_paths(df).collect())
    assert best == [(k, f"s{k}", 151.0) for k in range(300)] + [(300, "t299", 151.0)]
    two = C.reply_paths(df, branches=2)
    assert two.where("branch = 2").count() == 300 and two.count() == 601


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)
    plan = C.format_conversations(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
