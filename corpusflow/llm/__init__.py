"""Operations of a training-data pipeline: sharding, neighbours, quality, language model, packing, extraction, privacy, copies, leaks, secrets."""
