import hashlib

from chainsift.llm import chat


def turns(spark, rows, cols="conv_id long, turn long, role string, text string"):
    return spark.createDataFrame(rows, cols)


def test_template_is_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "a\\<s>b", "<\\s>", "[\\INST]", "", None, "<s", "é[/INST]\n</s>"]
    df = turns(spark, [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(texts)])
    row = chat.conversations(chat.format_paths(chat.paths(df))).first()
    assert chat.parse(row.formatted) == [("user" if k % 2 else "assistant", t or "") for k, t in enumerate(texts)]
    assert row.formatted.count("</s>") == len(texts)


def test_digest_reads_back(spark):
    df = turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "<s>yo"), (2, 0, None, None), (None, 3, "assistant", "z")])
    got = {r.conv_id: r for r in chat.digest(chat.format_paths(chat.paths(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\n<s>yo\n") and got[1].loss_sha256 == sha("<s>yo") and got[1].loss_chars == 5
    assert got[2].turns_sha256 == sha("\n\n") and got[2].loss_chars == 0
    assert got[None].n_turns == 1


def test_best_paths_of_a_tree(spark):
    #      0 - 1 - 3
    #        \ 2 - 4 ;  5 is a root of its own, 6 names a later parent
    rows = [(1, 0, "user", "q", None, 0.0), (1, 1, "assistant", "a", 0, 1.0), (1, 2, "assistant", "b", 0, 2.0), (1, 3, "user", "c", 1, 5.0), (1, 4, "user", "d", 2, None), (1, 5, "user", "e", 99, 0.5), (1, 6, "user", "f", 7, 0.1)]
    df = turns(spark, rows, "conv_id long, turn long, role string, text string, parent long, score double")
    got = {}
    for r in chat.paths(df, best=9).orderBy("branch", "pos").collect():
        got.setdefault(r.branch, []).append(r.text)
    assert got == {1: ["q", "a", "c"], 2: ["q", "b", "d"], 3: ["e"], 4: ["f"]}


def test_long_chain_ties_and_empty(spark):
    df = turns(spark, [(1, k // 2, "user", f"t{k:03d}") for k in range(150)] + [(2, 0, "user", "same"), (2, 0, "user", "same")])
    got = {r.conv_id: r for r in chat.digest(chat.format_paths(chat.paths(df))).collect()}
    assert got[1].n_turns == 150 and got[2].n_turns == 2
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"user\nt{k:03d}\n" for k in range(150)).encode()).hexdigest()
    assert chat.digest(chat.format_paths(chat.paths(df.limit(0)))).count() == 0
