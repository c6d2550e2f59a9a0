import hashlib
import hmac
import uuid

import pytest
from pyspark.sql import functions as F

from recollect.functions import arrow as A


@pytest.mark.parametrize(
    "function,text,want",
    [
        (A.normal_text, " Ａ\xa0 b \n\n c\t d ", "A b\nc d"),
        (A.normal_text, None, None),
        (A.html_nodes, "<p>a &amp; b</p> <script>x=1</script><p> </p>c", "a & b\nx=1\nc"),
        (A.canonical_json, '{"b": [1, {"d": 1, "c": 2}], "a": "é"}', '{"a": "é", "b": [1, {"c": 2, "d": 1}]}'),
        (A.canonical_json, "{", None),
        (A.fenced_json, 'so\n```json\n{"a": 1}\n```\nend', '{"a": 1}'),
        (A.fenced_json, 'take {"a": 2} now', '{"a": 2}'),
        (A.fenced_json, "nothing", None),
        (lambda c: A.keyed_id(c, b"k", "user"), "u", "dream-v1-" + hmac.new(b"k", b"dream-v1:user:u", hashlib.sha256).hexdigest()),
        (A.job_id, "n", str(uuid.uuid5(uuid.NAMESPACE_URL, "n"))),
        (A.folded, "Straße", "strasse"),
    ],
)
def test_functions(spark, function, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(function(F.col("t"))).first()[0] == want
