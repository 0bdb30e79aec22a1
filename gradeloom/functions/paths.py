"""Parts of a file id ``devset/<domain>/<file>.txt``, however it is spelled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def domain_of(fileid: Column | str, root: str = "devset") -> Column:
    """The folder below ``root`` in lower case, its words joined by underscores; null where there is none.

    Back slashes, doubled slashes, leading ./ or /, blanks around a part and other letter case make no difference.
    """
    path = F.lower(F.regexp_replace(fileid if isinstance(fileid, Column) else F.col(fileid), r"\\", "/"))
    folder = F.regexp_extract(path, rf"(?:^|/)\s*{root}\s*/[\s/]*([^/]+)/", 1)
    name = F.regexp_replace(F.regexp_replace(folder, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(name != "", name)
