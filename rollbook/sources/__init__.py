"""Where rows come from and where they go: tables, JSON requests, log lines, sinks."""
