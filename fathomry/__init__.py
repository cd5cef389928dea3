"""fathomry: feature-set evaluation, experiment analytics and dataset work on Spark."""
