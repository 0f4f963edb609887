"""Interrupted, repeated and simultaneous writers."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest

import tamis
from tamis import intake
from tamis.functions import fixed
from tamis.sources import files, registry
from tamis.sources.vault import Vault
from tamis.streaming.intake import refusals, watch


@pytest.fixture()
def store(tmp_path):
    return intake.Store(str(tmp_path / "store"))


def people(tmp_path, name, values):
    path = tmp_path / name
    path.write_text("mail,n\n" + "".join(f"{v}@x.fr,{i}\n" for i, v in enumerate(values)))
    return str(path)


def test_of_many_writers_of_a_name_one_makes_the_file(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: files.create_new(spark, f"{tmp_path}/d/entry.json", f"{i}" * 1000), range(24)))
    assert sum(made) == 1
    content = (tmp_path / "d/entry.json").read_text()
    assert content == f"{made.index(True)}" * 1000 and files.names(spark, f"{tmp_path}/d") == ["entry.json"]
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["entry.json"]


def test_masking_that_stops_before_its_commit_is_done_again_without_a_trace(spark, tmp_path, store, monkeypatch):
    row = intake.register(spark, store, "w", people(tmp_path, "p.csv", "abca"))
    commit = registry.commit

    def stop(*_):
        raise OSError("lost")

    monkeypatch.setattr(registry, "commit", stop)
    with pytest.raises(OSError):
        intake.pseudonymise(spark, store, row["id"])
    assert store.tokens(spark).count() == 0 and spark.read.parquet(store.mappings).count() == 3
    assert registry.find(registry.read(spark, store.registry), row["id"])["pii_status"] == fixed.PII_FOUND
    monkeypatch.setattr(registry, "commit", commit)
    result = intake.pseudonymise(spark, store, row["id"])
    assert store.tokens(spark).count() == 3 == result["valeurs_masquees"]
    assert [r.version for r in registry.versions(spark, store.registry, row["id"]).orderBy("version").collect()] == [1, 2]


def test_of_two_maskings_of_a_dataset_one_is_refused(spark, tmp_path, store, monkeypatch):
    row = intake.register(spark, store, "w", people(tmp_path, "p.csv", "abca"))
    commit, others = registry.commit, []

    def overtaken(*arguments):  # another one runs from start to end just before
        monkeypatch.setattr(registry, "commit", commit)
        others.append(intake.pseudonymise(spark, store, row["id"]))
        return commit(*arguments)

    monkeypatch.setattr(registry, "commit", overtaken)
    with pytest.raises(tamis.Refused, match="entre-temps"):
        intake.pseudonymise(spark, store, row["id"])
    (listed,) = registry.listing(registry.read(spark, store.registry)).collect()
    assert listed.pii_status == fixed.PII_MASKED and store.tokens(spark).count() == 3
    # What the refused one wrote is gone, what the other wrote is there.
    assert spark.read.parquet(store.mappings).count() == 3 and spark.read.parquet(others[0]["path"]).count() == 4


def test_a_dataset_is_registered_once(spark, tmp_path, store):
    path = people(tmp_path, "p.csv", "ab")
    first = intake.register(spark, store, "w", path)
    again = intake.register(spark, store, "w", path)
    assert again["id"] == first["id"] and again["created_at"].timestamp() == pytest.approx(first["created_at"].timestamp(), abs=1e-5)
    assert registry.read(spark, store.registry).count() == 1
    assert json.loads(registry.profile_of(registry.read(spark, store.registry), first["id"]))["nb_lignes"] == 2


def test_a_replayed_batch_registers_and_refuses_nothing_twice(spark, tmp_path, store):
    drop = tmp_path / "drop"
    drop.mkdir()
    people(drop, "a.csv", "ab")
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "made.parquet"))
    (part,) = (tmp_path / "made.parquet").glob("part-*.parquet")
    (drop / "n.parquet").write_bytes(part.read_bytes())
    (drop / "bad.csv").write_text("a,b\n1,2,3\n")
    (drop / "other.txt").write_text("x")
    for _ in range(2):
        watch(spark, str(drop), store, "w").awaitTermination()
        # As after a failure before the checkpoint was written: the batch comes again, with another checkpoint.
        store_again = intake.Store(store.folder)
        (tmp_path / "store/suivi").rename(tmp_path / f"suivi-{_}")
        watch(spark, str(drop), store_again, "w").awaitTermination()
    names = sorted(r.name for r in registry.read(spark, store.registry).collect())
    assert names == ["a.csv", "n.parquet"] and refusals(spark, store).count() == 1


def table(spark, values):
    return spark.createDataFrame([(i, f"{v}@x.fr") for i, v in enumerate(values)], "n int, mail string").coalesce(1)


def shown(spark, vault):
    return {r.empreinte: (r.rang, r.jeton) for r in vault.read(spark).collect()}


def test_interleaved_extensions_give_unique_and_stable_tokens(spark, tmp_path):
    vault, kinds = Vault(str(tmp_path / "coffre")), {"mail": fixed.EMAIL}
    vault.extend(table(spark, "ab"), kinds, order_by="n")
    before = shown(spark, vault)
    assert sorted(before.values()) == [(1, "email_001@masked.local"), (2, "email_002@masked.local")]
    one = vault.prepare(table(spark, "acd"), kinds, order_by="n")  # c and d are new to it
    two = vault.prepare(table(spark, "dbe"), kinds, order_by="n")  # so are d and e
    assert shown(spark, vault) == before  # nothing counts that is not committed
    two.commit(spark)
    middle = shown(spark, vault)
    one.commit(spark)
    after = shown(spark, vault)
    assert before.items() <= middle.items() <= after.items()
    assert len(after) == 5 and len({rank for rank, _ in after.values()}) == len({token for _, token in after.values()}) == 5
    # A third writer finds all of them, and an extension that was never committed leaves a gap only.
    vault.prepare(table(spark, "f"), kinds, order_by="n")
    mapping = vault.extend(table(spark, "abcdef"), kinds, order_by="n").collect()
    assert {r.empreinte: (r.rang, r.jeton) for r in mapping}.items() >= after.items() and len(mapping) == 6
    assert len({r.jeton for r in mapping}) == 6
    assert vault.prepare(table(spark, "abc"), kinds, order_by="n") is None


def test_writers_at_the_same_time_never_share_a_rank(spark, tmp_path):
    vault = Vault(str(tmp_path / "coffre"))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: vault.extend(table(spark, [f"{i}{j}" for j in range(4)] + ["same"]), {"mail": fixed.EMAIL}, order_by="n"), range(3)))
    found = shown(spark, vault)
    assert len(found) == 13 and len({token for _, token in found.values()}) == 13


def test_datasets_masked_with_one_vault_share_tokens(spark, tmp_path, store):
    vault, seen = Vault(str(tmp_path / "coffre")), []
    for name, values in (("p.csv", "abca"), ("q.csv", "xcba")):
        row = intake.register(spark, store, "w", people(tmp_path, name, values))
        masked = spark.read.parquet(intake.pseudonymise(spark, store, row["id"], vault=vault)["path"]).orderBy("n")
        seen.append([r.mail for r in masked.collect()])
    assert seen[0][0] == seen[0][3] == seen[1][3] and seen[0][1] == seen[1][2] and seen[0][2] == seen[1][1]
    assert seen[1][0] not in seen[0] and vault.read(spark).count() == 4
