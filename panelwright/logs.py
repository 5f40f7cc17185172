"""Log lines of the driver, and the progress of the tasks it waits for."""

from __future__ import annotations

import logging
import threading
from contextlib import contextmanager

from pyspark.sql import SparkSession

logger = logging.getLogger("panelwright")


@contextmanager
def progress(spark: SparkSession, what: str, every: float = 10.0):
    """Logs the begin and end of the work within, and every few seconds how many tasks of the active stages are done."""
    done = threading.Event()
    tracker = spark.sparkContext.statusTracker()

    def watch() -> None:
        while not done.wait(every):
            stages = [s for i in tracker.getActiveStageIds() if (s := tracker.getStageInfo(i))]
            logger.info("%s: %d of %d tasks", what, sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages))

    logger.info("%s: started", what)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    except Exception:
        logger.exception("%s: failed", what)
        raise
    finally:
        done.set()
        watcher.join()
    logger.info("%s: done", what)
