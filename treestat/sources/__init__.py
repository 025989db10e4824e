"""Reading and writing catalogues, exports, scan metadata and the listing job."""
