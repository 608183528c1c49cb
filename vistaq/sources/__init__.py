"""Sources and sinks: media listings, feeds, posts and catalogues. What fetches is given; what is parsed here runs in Spark."""
