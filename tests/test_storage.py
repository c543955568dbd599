import os
import time

from pagemill.sources import storage


def test_cleanup_takes_old_folders_only(spark):
    old, new = storage.shared_dir(spark), storage.shared_dir(spark)
    other = os.path.join(os.path.dirname(old), "pagemill-notes")
    for folder in (old, new, other):
        storage.touch(spark, f"{folder}/table/_SUCCESS")
    os.utime(old, (time.time() - 9000,) * 2)
    os.utime(other, (time.time() - 9000,) * 2)
    assert storage.cleanup(spark, 3600) == [os.path.basename(old)]
    assert not os.path.exists(old) and os.path.exists(new) and os.path.exists(other)
    assert storage.cleanup(spark, 3600) == []


def test_parents_of_marks(spark, tmp_path):
    root = str(tmp_path)
    for name in ("load=2", "load=1"):
        storage.touch(spark, f"{root}/{name}/_SUCCESS")
    storage.touch(spark, f"{root}/load=3/part")
    assert storage.parents_of(spark, root, "_SUCCESS") == ["load=1", "load=2"]
    assert storage.parents_of(spark, f"{root}/none", "_SUCCESS") == []
