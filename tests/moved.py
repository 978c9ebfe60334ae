"""What the stages of a piece of work shuffle and spill, from Spark's own status store."""


def _sums(spark):
    jvm = spark._jvm
    stages = spark._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark._sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    own = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in own), sum(s.diskBytesSpilled() for s in own), sum(s.shuffleWriteRecords() for s in own)


def moved(spark, work):
    """(bytes shuffled, bytes spilled, rows shuffled) by `work()` and its result."""
    bus = spark._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = _sums(spark)
    out = work()
    bus.waitUntilEmpty()
    return tuple(b - a for a, b in zip(before, _sums(spark))), out
