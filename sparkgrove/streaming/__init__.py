"""No streaming operators: the pipeline needs the complete point set, so results on a stream prefix
would not be prefixes of the results. A streaming job can call the batch API from foreachBatch."""
