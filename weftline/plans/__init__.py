"""Plans put together from operators: normalisation, fusion, projection."""
