"""Return-panel analytics and portfolio search as Spark DataFrame operators."""
