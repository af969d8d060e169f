"""Query texts that the Spark queries and their SQL share."""

#: A query with a repeated term; and a batch.
QUERY = "only anea erou only thanedble"
BATCH = [(1, "anea thanedble"), (2, "the erou tionea"), (3, "only anea only"), (4, "zzzz eauouon"), (5, "thanedble erou ontha ingble")]
#: The batch, a word that is in a third of the documents, and two such words: what pruning is for.
PRUNED = [*BATCH, (6, "tion"), (7, "tion ing")]
#: Shards of the blocks that SQL lays out too.
SHARDS = 64
LOOKUP, LOOKUP_MANY = "anea", ["anea", "thanedble", "erou", "zzzz"]
#: How the columns of the projected text are joined.
PROJECTED = ("source", "lang", "text")
TOP = 10
#: Result sizes of the benchmark loop.
SIZES = [10, 20, 50]
#: Document and query letters of the weighting schemas that have a query: each letter at each place.
SCHEMAS = [("lnc", "ltc"), ("nnn", "nnn"), ("btc", "lpc"), ("npc", "btn"), ("ltn", "nnc"), ("bpn", "bpc"), ("nnc", "lnn"), ("lpn", "ntn")]
