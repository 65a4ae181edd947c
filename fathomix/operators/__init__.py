"""DataFrame operators: discovery, description, subsetting, thinning, trees, chat logs."""
