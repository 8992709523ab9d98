"""Where rows come from and go to: layouts, stage tables, images, answers, benchmark files."""
