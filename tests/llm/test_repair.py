"""Conversation repair against a plain dynamic program over whole edit strings, and against its SQL text."""

import random

import duckdb
import pytest

from pulsegrid.llm import queries, repair

random.seed(3)


def plain(rows):
    """(cost, edits) of rows (initial, must go, cut off), by comparing whole strings."""

    def inserted(best):
        best = dict(best)
        for _ in range(4):
            for state, (cost, edits) in list(best.items()):
                to, made = 3 if state == 2 else 2, (cost + 3, edits + "I")
                if to not in best or made < best[to]:
                    best[to] = made
        return best

    best = {0: (0, "")}
    for initial, must, cut in rows:
        new = {}
        for state, (cost, edits) in inserted(best).items():
            moves = [(state, 4, "D")]
            if not must:
                stay = 3 if cut else 0
                moves.append((3 if state == 2 else 2, 3 + stay, "R"))
                if (initial, state) in {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}:
                    moves.append(({"s": 1, "u": 2, "a": 3}[initial], stay, "K"))
            for to, more, edit in moves:
                made = (cost + more, edits + edit)
                if to not in new or made < new[to]:
                    new[to] = made
        best = new
    best = inserted(best)
    return min(best[s] for s in (0, 3) if s in best)


def test_edits_equal_the_plain_program_whole_and_in_pieces():
    for _ in range(4000):
        n = random.randint(1, 14)
        rows = [(random.choice("suaaut "), random.random() < 0.2, random.random() < 0.3) for _ in range(n)]
        flagged = [(i, 1 if must else 2 * cut, 1) for i, must, cut in rows]
        want = plain([(i, must, cut and not must) for i, must, cut in rows])
        cost, edits = repair._row_edits(flagged)
        assert (cost, "".join(edits)) == want
        cuts = sorted({0, n, *(random.randint(0, n) for _ in range(3))})
        pieces = [flagged[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        total, path = repair._through([repair._summary(p) for p in pieces])
        assert (total, "".join("".join(repair._row_edits(p, e, t)[1]) for p, (e, t) in zip(pieces, path, strict=True))) == want


def test_survivors_that_agree_leave_no_tree_and_open_ones_stay_quick():
    run, most = repair.Survivors(), 0
    for i in range(20_000):
        run.row("ua"[i % 2], False, False)
        most = max(most, max(b[1].depth for b in run.best if b) - run.root.depth)
    assert most < 8 and len(run.settled) > 19_990
    assert repair._row_edits([("t", 0, 1)] * 20_000)[0] == 60_000  # two phases stay open to the end


def edge_rows():
    said = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes"), (2, None, None, None), (2, 5, "user", ""), (2, 5, "user", ""), (None, None, "user", "a."), (None, 3, "assistant", "b!"),
            (3, 7, "tool", "x?"), (3, 7, "assistant", "x?"), (3, 9, "", "odd. \n\t"), (3, 1, "user", "été? "), (4, None, "user", " \x0b\r\n")]
    said += [(5, t, random.choice(["user", "assistant", "tool", "system"]), random.choice(["Ok.", "No", f"t {t}.", f"t {t}", " "])) for t in range(900)]
    said += [(6, t // 3, "user", "same.") for t in range(300)] + [(7, 1, "user", "again.")] * 40
    said += [(c, t, ("user", "assistant")[t % 2], "long " * (20_000 if c == 20 else 3) + ".") for c in range(10, 60) for t in range(4)]
    return said


@pytest.mark.parametrize("partitions", ["3", "16"])
def test_query_equals_its_sql(spark, tmp_path, partitions):
    import pandas as pd

    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    frame = spark.createDataFrame([(*r, 7, "x") for r in edge_rows()], "conv_id bigint, turn bigint, role string, text string, n bigint, kind string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op13_repair_conversations"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op13_repair_conversations"]).df()
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    key = lambda d: sorted(map(repr, d.astype(object).where(pd.notna(d), None).itertuples(index=False)))
    assert key(got[want.columns].astype({c: "Int64" for c in want.columns[:7]})) == key(want.astype({c: "Int64" for c in want.columns[:7]}))


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["op13_repair_conversations"](spark, str(tmp_path)).count() == 0
