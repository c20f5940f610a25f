"""Reading and writing: tables with soft deletes, shared storage, feeds and pages, exports."""
