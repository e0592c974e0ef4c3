"""Fixed values that results depend on (stated once, used by code and oracles)."""

# Report scaling of rotational constants; cumulative explained-
# variance target; constant mean-distance cut; near-duplicate distance.
ROW_SCALE = 0.9971
CUMULATIVE_TARGET = 0.98758
DISTANT_CONST = 0.88
DIST_THRES = 1e-5

# The observed inventory: a short stated list of keys of the vector store.
OBSERVED_KEYS = tuple(range(20))
OBSERVED_SQL = f"vec_id IN ({', '.join(map(str, OBSERVED_KEYS))})"
