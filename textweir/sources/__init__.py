"""Where rows come from: tables, derived views and file scans."""
