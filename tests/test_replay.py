"""Plans replayed from kept states."""

import pytest

from tamis.operators import cleaning, replay
from tamis.sources import files


@pytest.fixture()
def table(spark):
    rows = [(1, "Data", 5.0), (2, "data", None), (3, "Data", -1.0), (3, "Data", -1.0), (4, None, 900.0)]
    return spark.createDataFrame(rows, "k int, s string, x double")


def plan(df):
    return [
        cleaning.regroup_spellings(df, "s"), cleaning.impute_mean(df, "x", 1), cleaning.CleaningAction(2, cleaning.DEDUPE),
        cleaning.CleaningAction(3, cleaning.NEGATIVES, "x"),
    ]


def rows(df):
    return sorted(map(str, df.collect()))


def test_switching_an_action_starts_from_the_state_before_it(spark, table, tmp_path):
    actions, folder = plan(table), str(tmp_path)
    expected = {}
    for off, skipped in ((None, 0), (None, 4), (3, 3), (2, 2), (0, 0), (1, 1), (None, 4), (2, 3)):
        chosen = actions if off is None else cleaning.toggled(actions, off, False)
        state, counts, kept = replay.replay(table, chosen, folder=folder, version="v1")
        assert kept == skipped, off
        assert rows(state) == rows(cleaning.replay(table, chosen)) and counts == cleaning.rows_affected(table, chosen)
        assert expected.setdefault(off, rows(state)) == rows(state)
    # Another version of the input, or another value of a parameter, has other states.
    assert replay.replay(table, actions, folder=folder, version="v2")[2] == 0
    changed = [cleaning.CleaningAction(1, cleaning.IMPUTE, "x", {"value": 7.0}) if a.order_index == 1 else a for a in actions]
    assert replay.replay(table, changed, folder=folder, version="v1")[2] == 1
    # A table among the parameters counts by its content, not by where it lies.
    assert replay.replay(table, plan(table), folder=folder, version="v1")[2] == 4


def test_states_may_be_kept_after_some_actions_only(spark, table, tmp_path):
    actions, folder = plan(table), str(tmp_path)
    state, counts, kept = replay.replay(table, actions, folder=folder, version="v", keep={1})
    assert kept == 0 and counts == cleaning.rows_affected(table, actions) and rows(state) == rows(cleaning.replay(table, actions))
    assert len([n for n in files.names(spark, folder) if n.endswith(".json")]) == 2
    assert replay.replay(table, cleaning.toggled(actions, 3, False), folder=folder, version="v")[2] == 2
    assert replay.forget(spark, folder, "v", actions) == 0  # that plan is a beginning of this one
    assert replay.replay(table, cleaning.toggled(actions, 1, False), folder=folder, version="v")[2] == 0
    assert replay.forget(spark, folder, "v", actions) == 2
    assert replay.replay(table, actions, folder=folder, version="v")[2] == 4
    assert replay.replay(table, [], folder=folder, version="v")[1:] == ([], 0)


def test_a_state_left_by_an_interrupted_replay_is_not_used(spark, table, tmp_path, monkeypatch):
    actions, folder = plan(table), str(tmp_path)

    def stop(*_):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(files, "create_new", stop)
        with pytest.raises(OSError):
            replay.replay(table, actions, folder=folder, version="v")
    state, counts, kept = replay.replay(table, actions, folder=folder, version="v")
    assert kept == 0 and counts == cleaning.rows_affected(table, actions)
