import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from textloom.llm.words import groups, hashed_words


def test_words_of_every_group_equal_the_pattern():
    r = random.Random(3)
    texts = ["".join(r.choice("aB é\n\t\x0b.Ç") for _ in range(r.randint(0, 200))) for _ in range(300)] + [None, "", " "]
    for chars in (1, 500, 1 << 20):
        got = []
        for rows, some in groups(list(range(len(texts))), pa.array(texts), chars):
            sizes, codes, hashes = hashed_words(some)
            assert len(rows) == len(sizes) and sizes.sum() == len(codes)
            got += [hashes[c].tolist() for c in np.split(codes, np.cumsum(sizes)[:-1])]
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
        want = [[np.uint64(xxhash.xxh64_intdigest(w.encode())).astype(np.int64).item() for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for t in low]
        assert got == want
