import pytest

from cartlens.config import Thresholds
from cartlens.plans.pipeline import Job
from cartlens.sources.adapter import CUTOFF, StarSource


def test_a_broken_step_is_resumed(spark, data_dir, tmp_path, monkeypatch):
    source, steps = StarSource(spark, data_dir), ("churn", "clean", "feature")
    make = lambda **c: Job(spark, source, str(tmp_path / "out"), Thresholds(cutoff_date=CUTOFF, **c), steps=steps)
    job = make()
    assert job.steps == ("clean", "feature", "churn") and not job.finished("clean")
    whole = Job.step_churn
    with monkeypatch.context() as m:
        def breaks(self):
            whole(self)  # outputs are there, but the step does not end
            raise RuntimeError("lost")

        m.setattr(Job, "step_churn", breaks)
        with pytest.raises(RuntimeError, match="lost"):
            job.run()
    assert [job.finished(n) for n in job.steps] == [True, True, False]
    assert make().run(resume=True) == ["churn"] and job.finished("churn")
    assert make().run(resume=True) == []
    before = job.stored("user_features_labelled").count()
    assert before == job.stored("user_features").count() > 0
    # other settings make the outputs stale; one step run alone makes the later ones stale
    assert not make(rfm_bins=5).finished("clean")
    assert make().run("feature") == ["feature"]
    assert [job.finished(n) for n in job.steps] == [True, True, False]


def test_unknown_steps_are_refused(spark, data_dir, tmp_path):
    with pytest.raises(ValueError, match="unknown"):
        Job(spark, StarSource(spark, data_dir), str(tmp_path), steps=("clean", "paint"))
