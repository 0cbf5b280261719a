"""How far a running write is, from Spark's status tracker."""

import threading

_GROUP, _SAYS = "spark.jobGroup.id", "spark.job.description"


class Watched:
    """While a block runs, ``tell(share)`` is called with the share of its tasks that have
    ended, whenever it has grown. The jobs of the block are told apart by a job group of
    their own; the one that the session had is put back.
    """

    def __init__(self, spark, name: str, tell, seconds: float):
        self.context, self.name, self.tell, self.seconds = spark.sparkContext, name, tell, seconds
        self.ended, self.before = threading.Event(), {}

    def __enter__(self):
        self.before = {k: self.context.getLocalProperty(k) for k in (_GROUP, _SAYS)}
        self.context.setJobGroup(self.name, self.name)
        self.thread = threading.Thread(target=self._watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_):
        self.ended.set()
        self.thread.join()
        for key, value in self.before.items():
            self.context.setLocalProperty(key, value)

    def _watch(self):
        told = 0.0
        while not self.ended.wait(self.seconds):
            share = self.share()
            if share > told:
                told = share
                self.tell(share)

    def share(self) -> float:
        tracker = self.context.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.name)]
        stages = [tracker.getStageInfo(s) for job in jobs if job for s in job.stageIds]
        tasks = sum(s.numTasks for s in stages if s)
        return sum(s.numCompletedTasks for s in stages if s) / tasks if tasks else 0.0
