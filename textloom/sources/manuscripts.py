"""Small LaTeX and Markdown manuscripts beside the documents, which hold no markup: the projections and detectors are exercised on both."""

from __future__ import annotations

#: Manuscripts by number; their doc_id is -100 and downwards. One paragraph a line, sections by heading commands.
MANUSCRIPTS = (
    r"""\documentclass{article} % the class
\newcommand{\Ns}{12}
\newcommand{\Nsamples}{1,250}
\newcommand{\unused}{7}
\newcommand{\lcdm}{$\Lambda$CDM model}
\input{macros} % \input{old}
\def\Ns{14}
\begin{document}
\begin{abstract}
We measure the mass of \Ns{} clusters and report $3.5\times10^{14}$ solar masses \citep[e.g.][]{Rich2001}. The result rests on two components.
\end{abstract}
\section{Introduction\label{sec:intro}}
In order to test this, we make use of \Nsamples{} galaxies~\cite{Fox2010,Owl2011}. Furthermore, the method is robust. Furthermore, the robust estimator works --- a testament to care.

Notably, it works, highlighting the trend. The rule: that a line ends. It is worth noting that $x$ is small.
\section[Short]{Methods \texorpdfstring{$\Lambda$CDM}{LCDM}}
First, we select stars. Second, we bin them. Third, we fit a non-weighted 200-image per-band stack now.

\begin{equation}
E = mc^2 \label{eq:dead}
\end{equation}
We tried a previous version; it no longer holds. The catalogue carries no stars of class B. TODO fix the units of 5\,Mpc and 1.5 kpc.
\subsection{Robust fits}
Moreover, moreover it may possibly fail. We must fit. We must test. We must stop. The map is drawn
over two lines (DES) here.
\begin{figure}
\includegraphics[width=3cm]{a.pdf}
\caption{A map without truncation and no \emph{outer ring}.}\label{fig:orphan}
\end{figure}
\section{Results}
In this section we describe the filter. The scatter is 0.5--1.2 dex, not larger, because the noise is lower than 43 counts. See Fig.~\ref{fig:used} and \eqref{eq:used}. \label{eq:used}
\begin{table*}
\caption{Rates}\label{fig:used}
\end{table*}
\section{Conclusions}
In summary, the map is drawn. One set is red and the next is another. This paper argues that rings exist. What matters here is the ring.
\section*{Acknowledgements}
We thank nobody \nocite{Hen2000}.
\end{document}
""",
    r"""\section{Introduction}
The tangential shear profile of each cluster is measured in ten radial bins around the brightest galaxy. It grows. The tangential shear profile of each stacked cluster is measured in ten radial bins around the brightest galaxy.

This is because the lens is massive, rather than light, not only here but there, instead of elsewhere. They never do.
\section{Data and observations}
Due to the fact that images are deep, a large number of sources remain, where $z$ denotes the redshift; where $z$ is the redshift. The number is 1{,}250 in \$5 bins 100\% of the time.
\section{Analysis}
The tangential shear profile of each cluster is not measured in ten radial bins around the brightest galaxy. Recent advances in optics help. In recent years it grew. Our method leverages a pivotal realm.
\begin{align*}
a &= b \\ c &= d
\end{align*}
Nothing is removed. The offset is not applied to the centre, and never-masked tiles stay. The step (removed) is \textcolor{red}{new}. We have added a paragraph on bias.
\section{Summary and discussion}
We define the aperture mass as $M_{ap}$. Hereafter the aperture mass (AM) is AM. As discussed above, of course, it holds.
""",
    r"""# A title

Some *prose* with a [link label](http://example.org/x) and **bold text** plus `code`.
> a quote
| a | b |
- an item
1. another item
---
![alt](img.png) ends here.

```
x = 1
```
A second paragraph -- with words.
""",
    r"""\section{Data}
The survey covers four fields that were observed over three winters, and each field was imaged in five bands by the same camera; the total area is large (about ninety square degrees), but the depth varies, however slightly, from field to field, and so does the seeing that sets the size of every object in the list.

Each image was reduced by the same steps. The bias was removed first, the flat field second, and the sky last. Stars were then selected by their size and by their colour, and galaxies were kept when their size was larger than that of the stars, although a few compact galaxies were lost in this way, which we accept.
\section{Methods}
We measure the shape of each galaxy with a single fit. The fit has six parameters, and it starts from the moments of the image; it stops when the change is small. We test the fit on simulated images of known shape, with the same noise and the same seeing, and we find no bias above one part in a thousand (see below). \citep{Elk2003}

The profile of each cluster is the mean of the shapes in rings. Ten rings are used, from the centre to the edge, and the error of a ring is the spread of its shapes divided by the root of their number. Rings with fewer than fifty galaxies are left out, while the rest are used as they are, without any further weight.
\section{Results}
Masses follow from the profiles by one more fit, now with two parameters. The masses of the forty clusters lie between one and nine units, and the scatter about the relation is small. Two clusters lie far from it; both are merging systems, yet their profiles look like those of the others, and we keep them in the list. It is $5$ units.

The relation between mass and richness is steep. Its slope is larger than one, despite the small range, and the offset agrees with that of earlier work within its error. A second fit without the two merging clusters gives the same slope, and a fit with all fields apart from the first gives a slope that is lower by a tenth.
""",
    r"""\section{Data}
The relation between mass and richness is steep. Its slope is larger than one, despite the small range, and the offset agrees with that of earlier work within its error. A second fit without the two merging clusters gives the same slope, and a fit with all fields apart from the first gives a slope that is lower by a tenth.

We measure the shape of each galaxy with a single fit. The fit has six parameters, and it starts from the moments of the image; it stops when the change is small. We test the fit on simulated images of known shape, with the same noise and the same seeing, and we find no bias above one part in a thousand (see below).
\section{Methods}
Masses follow from the profiles by one more fit, now with two parameters. The masses of the forty clusters lie between one and nine units, and the scatter about the relation is small. Two clusters lie far from it; both are merging systems, yet their profiles look like those of the others, and we keep them in the list.

The survey covers four fields that were observed over three winters, and each field was imaged in five bands by the same camera; the total area is large (about ninety square degrees), but the depth varies, however slightly, from field to field, and so does the seeing that sets the size of every object in the list.
\section{Results}
The profile of each cluster is the mean of the shapes in rings. Ten rings are used, from the centre to the edge, and the error of a ring is the spread of its shapes divided by the root of their number. Rings with fewer than fifty galaxies are left out, while the rest are used as they are, without any further weight.

Each image was reduced by the same steps. The bias was removed first, the flat field second, and the sky last. Stars were then selected by their size and by their colour, and galaxies were kept when their size was larger than that of the stars, although a few compact galaxies were lost in this way, which we accept.

We measure the shape of each galaxy with a single fit. The fit has six parameters, and it starts from the moments of the image; it stops when the change is small. We test the fit on simulated images of known shape, with the same noise and the same seeing, and we find no bias above one part in a thousand (see below).
""",
)
