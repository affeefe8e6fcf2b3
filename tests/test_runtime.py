import numpy as np
import pytest

from tessera.plans import runtime


def test_folders(tmp_path, monkeypatch):
    monkeypatch.setenv(runtime.DATA_VARIABLE, str(tmp_path))
    assert runtime.data_root() == tmp_path.resolve()
    with pytest.raises(FileNotFoundError):
        runtime.data_root(str(tmp_path / "none"))
    assert runtime.report_root(str(tmp_path / "r" / "s")).is_dir()


def test_log_goes_to_the_file_while_it_lasts(tmp_path):
    with runtime.run_log(tmp_path / "run.txt") as log:
        log.info("one")
        log.warning("two")
    log.info("three")
    assert (tmp_path / "run.txt").read_text().splitlines() == ["one", "WARNING: two"]


def test_schedule_and_training_reach_the_least_squares_fit():
    assert runtime.Schedule(7, steps=20).total == 21 and runtime.Schedule(7, epochs=2).total == 14
    assert runtime.Schedule(10, epochs=1).rate(10, 1.0) == pytest.approx(0)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5]
    w = [np.zeros(3)]

    def slopes(weights, rows):
        gap = x[rows] @ weights[0] - y[rows]
        return {"loss": (gap**2).mean()}, [2 * x[rows].T @ gap / len(rows)]

    history = runtime.train(w, lambda: np.array_split(np.arange(200), 5), slopes, runtime.Schedule(5, steps=1500), 0.05, clip=10.0)
    assert np.allclose(w[0], [1, -2, 0.5], atol=1e-2) and history[-1]["loss"] < history[0]["loss"]
