"""User-level jobs: plot data for one or many datasets, and subset export."""
