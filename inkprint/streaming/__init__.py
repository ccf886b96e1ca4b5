"""The stateless feature projection applied to a stream of documents."""
