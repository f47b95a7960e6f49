"""Named secrets and mail addresses of any length and form."""

import random
import re

from pagewright.llm import pii


def test_secrets_and_addresses_have_no_bounds(spark):
    draw = random.Random(8)
    long = "".join(draw.choices("abcdefghjkmnpqrstuvwxyz23456789", k=600))
    giant = "".join(draw.choices("ABCDEFGHJKMN23456789", k=20_000))
    texts = [
        f"secret={long} end",
        "token=aaaK.bbbbQ7.cccc99zz, then token=aaaK.bbbbQ7.cccc99zz.",
        "password=p@ssw0rd!2024 and password: 'p@ssw0rd!2024' stay equal",
        f"write to {long[:90]}.tail@mail.example.com now",
        f"api_key={giant}",
    ]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0].startswith("secret=") and got[0].endswith(" end") and len(got[0]) == len(texts[0])
    assert not any(long[i : i + 12] in got[0] for i in range(589))
    first, second = re.findall(r"token=([^\s,]+?)[,.](?:\s|$)", got[1])
    assert first == second and not {"aaaK", "bbbbQ7", "cccc99zz"} & set(first.split("."))
    first, second = re.search(r"password=(\S+) and password: '(\S+)' stay equal", got[2]).groups()
    assert first == second and re.fullmatch(r"[a-z]@[a-z]{3}\d[a-z]{2}!\d{4}", first) and first != "p@ssw0rd!2024"
    assert long[:12] not in got[3] and long[60:90] not in got[3] and ".com now" in got[3]
    assert len(got[4]) == len(texts[4]) and not any(giant[i : i + 12] in got[4] for i in range(0, 19_980, 50))
