"""Small link tables take few tasks, and both ways of joining minima give the same components."""

from rasterloom.llm import components as c


def tasks_of(spark, group, work):
    """Result of the work, and how many tasks ran for it."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        out = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
    return out, sum(info.numCompletedTasks for s in stages if (info := status.getStageInfo(s)))


def test_small_tables_take_few_tasks(spark, monkeypatch):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 8 != 7] + [(100, i) for i in range(101, 500)], "u long, v long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        find = lambda: {r.id: r.component for r in c.components(links, "u", "v").collect()}
        got, tasks = tasks_of(spark, "small", find)
        monkeypatch.setattr(c, "HUBS", 1 << 6)  # 2 * 434 edges exceed it: as large tables go, in several tasks
        monkeypatch.setattr(c, "SHARE", 1 << 7, raising=False)
        large = find()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == large == {i: i - i % 8 for i in range(41) if i < 40} | {i: 100 for i in range(100, 500)}
    assert tasks < 400, tasks
