"""treestat: file-system metadata analytics as ordinary Spark jobs."""
