"""DataFrame -> DataFrame operators of the mining job."""
