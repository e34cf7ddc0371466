"""Music-catalog building, taste profiles, playlists and their measurement as PySpark DataFrame operators."""
