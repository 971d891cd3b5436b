"""Jobs composed from the operators: dataset, evaluation, training, prediction, studies."""
